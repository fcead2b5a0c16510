"""Words of texts as numbers, for whole batches of texts at once."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of texts that are taken apart at once within a task.
SLICE_CHARS = 4_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,400}>")
_BLOCK = re.compile(r"<(?:/?(?:p|div|br|li|ul|ol|td|tr|th|table|h[1-6]|blockquote|pre|section|article)\b)[^<>]{0,400}>", re.I)
_BLANKS = re.compile(r"&(?:nbsp|#160|#xa0|ensp|emsp|thinsp);")
_NOTHING = re.compile(r"&(?:shy|#173|zwnj|zwj);")
_APOSTROPHES = re.compile(r"&(?:#39|#x27|apos|rsquo|lsquo|#8217|#8216);")
_ENTITY = re.compile(r"&[A-Za-z#0-9]{2,8};")
_BROKEN = re.compile(r"[-‐‑](?<=[^\W\d_].)[ \t]*\r?\n[ \t>|*#]*(?=[^\W\d_])")
_SOFT = [0xAD, *range(0x200B, 0x200E), 0x2060, 0xFEFF]
_JOINING = [ord(c) for c in "-‐‑'’"]


@lru_cache
def _kinds() -> np.ndarray:
    """For each character: 1 if it belongs to a word, 2 if it is left out, 3 if it is left out between two characters of a word, else 0."""
    out = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[_SOFT], out[_JOINING] = 2, 3
    return out


@lru_cache
def _digits() -> np.ndarray:
    return np.fromiter((chr(i).isdigit() for i in range(0x110000)), dtype=np.uint8, count=0x110000)


def _plain(text: str | None) -> str:
    """Small letters without markup; a word broken by a hyphen at a line's end is whole again."""
    t = text or ""
    if "<" in t:
        t = _TAG.sub("", _BLOCK.sub(" ", t))
    if "&" in t:
        t = _ENTITY.sub(" ", _APOSTROPHES.sub("'", _NOTHING.sub("", _BLANKS.sub(" ", t))))
    if "\n" in t:
        t = _BROKEN.sub("", t)
    return (t if t.isascii() else unicodedata.normalize("NFC", t)).lower()


def _characters(texts: list[str], parting: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, whether each belongs to a word, text that each comes from) of plain texts, without what is left out."""
    c = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    kind = _kinds()[c]
    for what in (2,) if parting else (2, 3):
        out = np.flatnonzero(kind == what)
        if what == 3 and len(out):
            inner = (out > 0) & (out < len(c) - 1)
            out = out[inner & (kind[out - 1] == 1) & (kind[np.minimum(out + 1, len(c) - 1)] == 1)]
        if len(out):
            c, owner, kind = np.delete(c, out), np.delete(owner, out), np.delete(kind, out)
    return c, kind == 1, owner


def _bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(text: str | None) -> list[str]:
    """The words of a text, as they are compared and counted here: small letters, without markup, punctuation and line breaks.

    Hyphens and apostrophes within a word vanish. A null text has no words.
    """
    c, inside, _ = _characters([_plain(text)])
    whole = c.tobytes().decode("utf-32-le")
    return [whole[i:j] for i, j in zip(*_bounds(inside))]


def normal_words(text: Column) -> Column:
    """``words_of`` as a column."""
    return F.pandas_udf(lambda s: pd.Series([words_of(t) for t in s], index=s.index, dtype=object), "array<string>")(text)


def hashed(texts: list[str | None], clean: bool = True, one_number: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text it comes from) of each word of the texts, in order.

    Words are those of ``words_of``; with ``clean`` false the texts are taken to be plain already, and hyphens and apostrophes part words. ``one_number`` gives all words of digits the hash 0.
    """
    c, inside, owner = _characters([_plain(t) for t in texts]) if clean else _characters([t.lower() for t in texts], parting=True)
    start, end = _bounds(inside)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    powers = np.multiply.accumulate(np.full(int(size.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    inner = c[inside]
    h = mixed(np.add.reduceat((inner.astype(np.uint64) + np.uint64(1)) * powers[place], first))
    if one_number:
        h[np.minimum.reduceat(_digits()[inner], first) == 1] = np.uint64(0)
    return h, owner[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def slices(b: pa.RecordBatch, text: str):
    """The batch in slices of about ``SLICE_CHARS``; a longer text is a slice of its own."""
    sizes = np.cumsum([len(t or "") for t in b[text].to_pylist()])
    cuts = np.flatnonzero(np.diff(sizes // SLICE_CHARS, prepend=0)) if len(sizes) else []
    for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
        if end > start:
            yield b.slice(start, end - start)
