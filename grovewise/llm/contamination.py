"""Evaluation texts within training texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.words import hashed, normal_words, slices, words_of

#: Words of a seed, of the shortest stretch that counts, and one error is allowed in so many words.
SEED, STRETCH, ONE_IN = 5, 14, 8
#: Characters of passages that are broadcast at once; larger test sets are searched for in blocks.
BLOCK_CHARS = 8_000_000
#: Pairs of like windows that are followed up at once.
SLICE_HITS = 1_000_000

_GONE = -(1 << 40)


def _windows(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its first word) of all windows of ``n`` words within one text."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + words[k : k + count]
    at = np.flatnonzero(owner[:count] == owner[n - 1 :])
    return h[at], at


@dataclass(frozen=True)
class TestSet:
    """Passages as one run of hashed words, with all their windows sorted by hash."""

    __test__ = False
    words: np.ndarray  # of all passages, one behind another
    begin: np.ndarray  # where each word's passage begins
    end: np.ndarray  # and where it ends
    passage: np.ndarray  # which passage each word belongs to
    items: list[list]  # ids of the items that have each passage
    seeds: np.ndarray  # distinct windows
    first: np.ndarray  # where each window's places begin in ``places``
    places: np.ndarray
    filter: np.ndarray  # whether any window's hash ends in these bits
    size: int  # words of a window

    @staticmethod
    def of(items: list[tuple], n: int, stretch: int) -> "TestSet":
        words, owner = hashed([p for _, p in items])
        cuts = np.searchsorted(owner, np.arange(len(items) + 1))
        same: dict[bytes, list] = {}
        for k, (i, _) in enumerate(items):
            if cuts[k + 1] - cuts[k] >= stretch:
                same.setdefault(words[cuts[k] : cuts[k + 1]].tobytes(), []).append(i)
        passages = [np.frombuffer(p, dtype=np.uint64) for p in same]
        sizes = np.array([len(p) for p in passages], dtype=np.int64)
        passage = np.repeat(np.arange(len(passages)), sizes)
        words = np.concatenate(passages) if passages else np.zeros(0, np.uint64)
        end = np.cumsum(sizes)
        h, at = _windows(words, passage, n)
        order = np.argsort(h, kind="stable")
        seeds, first = np.unique(h[order], return_index=True)
        mask = np.zeros(1 << 22, dtype=bool)
        mask[seeds & np.uint64(len(mask) - 1)] = True
        return TestSet(words, (end - sizes)[passage], end[passage], passage, list(same.values()), seeds, np.append(first, len(h)), at[order], mask, n)

    def hits(self, words: np.ndarray, owner: np.ndarray):
        """(places in the documents, places in the passages) of like windows, in lots of bounded size."""
        h, at = _windows(words, owner, self.size)
        maybe = self.filter[h & np.uint64(len(self.filter) - 1)]
        h, at = h[maybe], at[maybe]
        if not len(h) or not len(self.seeds):
            return
        k = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        known = self.seeds[k] == h
        k, at = k[known], at[known]
        many = self.first[k + 1] - self.first[k]
        lots = np.cumsum(many) // SLICE_HITS
        for lot in np.unique(lots):
            these = lots == lot
            k_, many_ = k[these], many[these]
            before = np.cumsum(many_) - many_
            yield np.repeat(at[these], many_), self.places[np.repeat(self.first[k_] - before, many_) + np.arange(int(many_.sum()))]


def _runs(p: np.ndarray, a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like windows that follow one another, as runs: (place in the documents, place in the passages, words)."""
    order = np.lexsort((p, p - a))
    p, a = p[order], a[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(a) != 1)
    start = np.flatnonzero(new)
    return p[start], a[start], np.diff(np.append(start, len(p))) + n - 1


def _reach(item: np.ndarray, doc: np.ndarray, a: np.ndarray, p: np.ndarray, a_end: np.ndarray, p_end: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words of the item follow on from each (a, p) with 0, 1, ... errors, and how many of the document, up to a last word that is alike.

    For each number of errors the furthest place on each diagonal is kept: a changed word stays on the diagonal, a left out or an added one changes it. An end bought with more errors than words, behind
    a longer row of errors, may be missed; a stretch without it is the better one.
    """
    far = np.full((2 * errors + 3, len(a)), _GONE, dtype=np.int64)  # diagonal -errors - 1 first
    zero = errors + 1
    gain, span = np.zeros((errors + 1, len(a)), dtype=np.int64), np.zeros((errors + 1, len(a)), dtype=np.int64)
    for e in range(errors + 1):
        before = far.copy()
        if e:
            gain[e], span[e] = gain[e - 1], span[e - 1]
        for k in range(-e, e + 1):
            row = zero + k
            y = np.maximum(np.maximum(before[row] + 1, before[row + 1] + 1), before[row - 1]) if e else np.zeros(len(a), dtype=np.int64)
            y = np.where((y < -k) | (a + y > a_end) | (p + y + k > p_end), _GONE, y)
            start = y.copy()
            live = np.flatnonzero(y >= 0)
            while len(live):
                i, d = a[live] + y[live], p[live] + y[live] + k
                live = live[(i < a_end[live]) & (d < p_end[live])]
                live = live[item[a[live] + y[live]] == doc[p[live] + y[live] + k]]
                y[live] += 1
            far[row] = np.maximum(y, before[row])
            better = (y > start) & (y > gain[e])
            gain[e][better], span[e][better] = y[better], y[better] + k
    return gain, span


def _longest(tests: TestSet, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, a: np.ndarray, run: np.ndarray, errors: int, stretch: int, one_in: int):
    """For each run the longest stretch around it that counts: (words, errors, first place in the documents, place behind its last); 0 words if none does.

    ``lo`` and ``hi`` are the bounds of the run's document.
    """
    m, n = len(tests.words), len(doc)
    right, after = _reach(tests.words, doc, a + run, p + run, tests.end[a], hi, errors)
    left, ahead = _reach(tests.words[::-1], doc[::-1], m - a, n - p, m - tests.begin[a], n - lo, errors)
    out = [np.zeros(len(p), dtype=np.int64) for _ in range(4)]
    for e in range(errors + 1):
        for one in range(e + 1):
            total = run + left[one] + right[e - one]
            better = (total >= max(stretch, one_in * e)) & (total > out[0])
            for o, v in zip(out, (total, np.full(len(p), e), p - ahead[one], p + run + after[e - one])):
                o[better] = v[better]
    return out


def _stretches(tests: TestSet, words: np.ndarray, owner: np.ndarray, stretch: int, one_in: int) -> np.ndarray:
    """Rows (document, passage, words, errors, first word, last word) of all stretches that count; none lies within another of its passage."""
    cuts = np.searchsorted(owner, np.arange(int(owner[-1]) + 2)) if len(owner) else np.zeros(1, np.int64)
    found = []
    for p, a in tests.hits(words, owner):
        p, a, run = _runs(p, a, tests.size)
        lo, hi = cuts[owner[p]], cuts[owner[p] + 1]
        # A stretch that holds no shorter one that counts has all its errors near its ends, so few that they are bounded.
        few = 3 * (stretch - 1) // (one_in - 1)
        counts = np.flatnonzero(_longest(tests, words, lo, hi, p, a, run, few, stretch, one_in)[0])
        if not len(counts):
            continue
        p, a, run, lo, hi = (v[counts] for v in (p, a, run, lo, hi))
        allowed = (tests.end[a] - tests.begin[a]) // one_in
        for most in np.unique(allowed):
            s = allowed == most
            n, e, first, behind = _longest(tests, words, lo[s], hi[s], p[s], a[s], run[s], int(most), stretch, one_in)
            found.append(np.stack([owner[p[s]], tests.passage[a[s]], n, e, first - lo[s], behind - lo[s] - 1], axis=1))
    if not found:
        return np.zeros((0, 6), dtype=np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], -rows[:, 5], rows[:, 4], rows[:, 1], rows[:, 0]))]
    keep, group, reached = [], None, -1
    for i, (d, k, _, _, first, last) in enumerate(rows.tolist()):
        if (d, k) != group:
            group, reached = (d, k), -1
        if last > reached:
            keep.append(i)
            reached = last
    return rows[keep]


def best_stretch(item: list[int], doc: np.ndarray, stretch: int = STRETCH, one_in: int = ONE_IN) -> tuple[int, int, int] | None:
    """(words of the item's stretch, errors, where it ends in doc) of the longest stretch that counts, else None; for one item and one document as numbers."""
    n = _least_run(stretch, one_in)
    words = np.array(item, dtype=np.int64).astype(np.uint64)
    count = len(words)
    h, at = _windows(words, np.zeros(count, np.int64), n)
    order = np.argsort(h, kind="stable")
    seeds, first = np.unique(h[order], return_index=True)
    tests = TestSet(words, np.zeros(count, np.int64), np.full(count, count), np.zeros(count, np.int64), [[0]], seeds, np.append(first, len(h)), at[order], np.ones(1, bool), n)
    got = _stretches(tests, np.array(doc, dtype=np.int64).astype(np.uint64), np.zeros(len(doc), np.int64), stretch, one_in)
    return max(((int(w), int(e), int(last) + 1) for _, _, w, e, _, last in got), default=None)


def _least_run(stretch: int, one_in: int) -> int:
    """Words that the longest unbroken run of any stretch that counts has at least."""
    return min(-(-(size - size // one_in) // (size // one_in + 1)) for size in range(stretch, stretch + one_in * 4))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", n: int = SEED, stretch: int = STRETCH, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, item_id, words, errors, first_word, last_word): each stretch of an item's passage that a document holds, verified.

    All windows of ``n`` words of every document are looked up in the broadcast set of the passages' windows, and each unbroken run of like windows is extended both ways word by word, with as many errors
    as its passage allows; both ends of a stretch are alike. A stretch of 14 words or more with at most one error in eight has an unbroken run of at least five words, so none is missed; ``n`` may not be
    larger than that. A document that holds a passage several times has a row for each; a stretch within another of the same item has none. It is a map over the documents, whole texts in bounded
    slices, without a shuffle of texts. Passages are broadcast in blocks of ``BLOCK_CHARS`` characters; each block is a scan of its own. Words are counted from 0 (``words_of``) and compared by
    64-bit hashes. Null and empty texts leak nothing; passages under ``stretch`` words can't hold a stretch (``short_items`` lists them). Repeated rows are reported once.
    """
    if not 1 <= n <= _least_run(stretch, one_in):
        raise ValueError(f"windows of {n} words would miss stretches: at most {_least_run(stretch, one_in)}")
    spark = documents.sparkSession
    given = items.filter(F.col(passage).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.col(passage).alias("p")).distinct()
    blocks = max(1, -(-(given.agg(F.sum(F.length("p"))).first()[0] or 0) // BLOCK_CHARS))
    docs = documents.filter(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(given.dtypes)["i"]
    shape = f"doc_id {doc_kind}, item_id {item_kind}, words int, errors int, first_word int, last_word int"
    item_type = given.limit(0).select("i").toArrow().schema.field("i").type
    out = None
    for block in range(blocks):
        rows = [(r["i"], r["p"]) for r in given.filter(F.pmod(F.xxhash64("p"), F.lit(blocks)) == block).collect()]
        tests = spark.sparkContext.broadcast(TestSet.of(rows, n, stretch))

        def run(batches, tests=tests):
            for b in batches:
                for part in slices(b, "text"):
                    found = _stretches(tests.value, *hashed(part["text"].to_pylist()), stretch, one_in)
                    wide = [(*r, i) for r in found.tolist() for i in tests.value.items[r[1]]]
                    ids = part["doc_id"].take(pa.array([r[0] for r in wide], pa.int64()))
                    numbers = [pa.array([r[c] for r in wide], pa.int32()) for c in range(2, 6)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([r[6] for r in wide], item_type), *numbers], ["doc_id", "item_id", "words", "errors", "first_word", "last_word"])

        found = docs.mapInArrow(run, shape)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def short_items(items: DataFrame, item_id: str = "item_id", passage: str = "passage", stretch: int = STRETCH) -> DataFrame:
    """(item_id, words) of the items that no document can be found to leak, as their passage is null or has under ``stretch`` words."""
    return items.select(F.col(item_id).alias("item_id"), F.size(normal_words(F.col(passage))).alias("words")).filter(F.col("words") < stretch)


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """Documents without those that leak, or (``whole`` false) with the normalised words of the leaking spans taken out, as ``text``.

    Spans that overlap are taken out once. Documents that leak nothing keep their text unchanged. Ids must be unique where spans are taken out.
    """
    if whole:
        return documents.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans):
            words = words_of(t)
            keep = np.ones(len(words), dtype=bool)
            for s in own:
                keep[s["first_word"] : s["last_word"] + 1] = False
            out.append(" ".join(w for w, k in zip(words, keep) if k))
        return pd.Series(out, dtype=object)

    spans = found.groupBy(F.col("doc_id").alias(doc_id)).agg(F.collect_set(F.struct("first_word", "last_word")).alias("_spans"))
    order = documents.columns
    cut = documents.join(spans, doc_id).withColumn(text, rest(F.col(text), F.col("_spans"))).select(order)
    return documents.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti").select(order).unionByName(cut)
