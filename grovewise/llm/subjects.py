"""Subject areas of texts: one-versus-rest linear classifiers on hashed word n-grams, applied sentence by sentence."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.words import hashed, mixed, slices
from grovewise.session import materialize

#: Features are hashed to so many buckets. The classifiers are fitted on at most so many labelled texts, and on at most so many sentences of so many documents that weak labels are tried on.
BUCKETS, EXAMPLES, WEAK_DOCUMENTS, WEAK_SENTENCES = 1 << 16, 20_000, 2_000, 60_000
#: A "sentence" of more features than this (tables, lists without full stops) isn't used to fit; it is classified like any other.
LONG_SENTENCE = 1_000
#: A document has a subject if at least this share of its sentences is about it.
SHARE = 0.2

# Parts of an address, a kind or a title that hint at a subject.
HINTS = {
    "permit": "law", "tenure": "law", "club": "sport", "bulletin": "sport", "issue": "software", "release": "software",
    "toolbox": "safety", "grant": "finance", "stand": "mensuration", "survey": "mensuration", "scan": "lidar",
}

_MARKUP = re.compile(r"<[^<>]{1,400}>|&[a-zA-Z#0-9]{2,8};")
_MARK = r"|\n\s*\n|\n\s*(?:[-*•]|\d+[.)])\s+"
_END = r"(?<=[.!?])[\"'”»)\]]*\s+(?=\S)"
_BREAK = re.compile(r"(?<!\d\.)" + _END + r"|(?<=\d\.)\s+(?![a-zäöüßáéíóúñ])(?=\S)" + _MARK)
_BREAK_LOWER = re.compile(_END + _MARK)
_LIST = re.compile(r"^\s*[-*•]\s+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text: split behind full stops, at blank lines and at list marks; what holds no two words is none.

    A number with a full stop before a small letter (an ordinal) ends no sentence, unless the text has no capitals at all.
    """
    return [p for p in _parts(text) if len(_WORD.findall(p)) > 1]


def _parts(text: str) -> list[str]:
    plain = _MARKUP.sub(" ", text) if "<" in text or "&" in text else text
    parts = [_LIST.sub("", p or "") for p in (_BREAK_LOWER if plain == plain.lower() else _BREAK).split(plain)]
    return [p for p in parts if p]


@dataclass(frozen=True)
class Rows:
    """Sentences as buckets of their words and word pairs, one sentence behind another; numbers count as one word."""

    flat: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(parts: list[str], buckets: int = BUCKETS) -> tuple["Rows", np.ndarray]:
        """(the rows of those parts that have two words or more, which parts these are)."""
        h, owner = hashed(parts, clean=False, one_number=True)
        enough = np.bincount(owner, minlength=len(parts)) > 1
        h, owner = h[enough[owner]], owner[enough[owner]]
        within = owner[1:] == owner[:-1]
        pairs = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1))[within]
        at = np.concatenate([owner, owner[1:][within]])
        flat = ((np.concatenate([h, pairs]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        return Rows(flat[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(parts))[enough]), np.flatnonzero(enough)

    @staticmethod
    def joined(rows: list["Rows"]) -> "Rows":
        return Rows(np.concatenate([r.flat for r in rows] or [np.zeros(0, np.int64)]), np.concatenate([r.size for r in rows] or [np.zeros(0, np.int64)]))

    @staticmethod
    def from_lists(lists: list[list[int]]) -> "Rows":
        return Rows(np.array([x for r in lists for x in r], dtype=np.int64), np.array([len(r) for r in lists], dtype=np.int64))

    def take(self, which: np.ndarray) -> "Rows":
        """The rows of these numbers or of this mask."""
        which = np.flatnonzero(which) if which.dtype == bool else which
        size = self.size[which]
        start = (np.cumsum(self.size) - self.size)[which]
        return Rows(self.flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size)

    def __len__(self) -> int:
        return len(self.size)


@dataclass(frozen=True)
class SubjectModel:
    """Weights (buckets, subjects), biases, and for each subject the score from which a sentence is about it; ``held`` are (subject, leading subject, its score) of held-out sentences."""

    subjects: list[str]
    weights: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray
    held: np.ndarray

    def scores(self, rows: Rows) -> np.ndarray:
        if not len(rows):
            return np.zeros((0, len(self.subjects)))
        starts = np.cumsum(rows.size) - rows.size
        return np.add.reduceat(self.weights[rows.flat], starts, axis=0) / np.sqrt(rows.size)[:, None] + self.bias

    @property
    def floor(self) -> float:
        """The score up to which no more is known of a sentence than the biases say."""
        return float(self.bias.max()) + 0.25


def _fit(rows: Rows, target: np.ndarray, weight: np.ndarray, buckets: int, rounds: int = 100, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression for each column of ``target``, by accelerated gradient descent on all rows; equal rows are taken together."""
    place: dict[bytes, int] = {}
    cuts = np.concatenate([[0], np.cumsum(rows.size)])
    at = np.array([place.setdefault(rows.flat[cuts[i] : cuts[i + 1]].tobytes() + target[i].tobytes(), len(place)) for i in range(len(rows))])
    _, first = np.unique(at, return_index=True)
    weight, rows, target = np.bincount(at, weight), rows.take(first), target[first]
    sizes = rows.size
    used, flat = np.unique(rows.flat, return_inverse=True)
    row_of = np.repeat(np.arange(len(rows)), sizes)
    starts = np.cumsum(sizes) - sizes
    by_feature = np.argsort(flat, kind="stable")
    row_by_feature, first = row_of[by_feature], np.searchsorted(flat[by_feature], np.arange(len(used)))
    scale = (1 / np.sqrt(sizes))[:, None].astype(np.float32)
    k = target.shape[1]
    target = target.astype(np.float32)
    w, bias = np.zeros((len(used), k), dtype=np.float32), np.full(k, -1.0, dtype=np.float32)
    ahead_w, ahead_b, t = w.copy(), bias.copy(), 1.0
    rate = np.float32(8.0)
    penalty = np.float32(penalty)
    share = (weight / weight.sum())[:, None].astype(np.float32)
    for _ in range(rounds):
        z = np.add.reduceat(ahead_w[flat], starts, axis=0) * scale + ahead_b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * share
        grad = np.add.reduceat((error * scale)[row_by_feature], first, axis=0) + penalty * ahead_w
        new_w, new_b = ahead_w - rate * grad, ahead_b - rate * error.sum(axis=0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        onward = np.float32((before - 1) / t)
        ahead_w, ahead_b = new_w + onward * (new_w - w), new_b + onward * (new_b - bias)
        w, bias = new_w, new_b
    out = np.zeros((buckets, k), dtype=np.float32)
    out[used] = w
    return out, bias


def useful_hints(model: SubjectModel, texts: list[tuple[tuple, Rows]], lift: float = 2.0) -> set[tuple[int, str]]:
    """Hints that hold, as (which hint of a text, subject): texts hinted at a subject lead with it at least ``lift`` times as often as other texts do."""
    top = [(hints, model.subjects[np.bincount(model.scores(rows).argmax(axis=1), minlength=len(model.subjects)).argmax()]) for hints, rows in texts if len(rows)]
    out = set()
    for which in range(max((len(h) for h, _ in top), default=0)):
        for name in model.subjects:
            inside, outside = [t == name for h, t in top if h[which] == name], [t == name for h, t in top if h[which] != name]
            if len(inside) >= 20 and outside and np.mean(inside) >= lift * max(np.mean(outside), 1 / (4 * len(model.subjects))):
                out.add((which, name))
    return out


def train(examples: list[tuple[str, str]], texts: list[tuple[tuple, Rows]] = (), buckets: int = BUCKETS, rounds: int = 2, margin: float = 1.0) -> SubjectModel:
    """Fit on (subject, text) examples, and on sentences of texts that carry at most weak labels (each text's hints, or nulls).

    First classifiers are fitted on the examples' sentences. In each further round the sentences of ``texts`` join with a lower weight: with a subject where one class leads by ``margin``, or where a hint of the
    text leads and such hints have been found to hold (``useful_hints``); as about nothing where no more is known of them than the biases say. Thresholds are
    set at the end on examples that were held out and on the sentences about nothing.
    """
    if not examples:
        raise ValueError("no labelled texts")
    names = sorted({s for s, _ in examples})
    index = {s: i for i, s in enumerate(names)}
    parts = [(n, p) for n, (_, text) in enumerate(examples) for p in _parts(text)]
    rows, which = Rows.of([p for _, p in parts], buckets)
    example = np.array([n for n, _ in parts], dtype=np.int64)[which]
    target = np.array([index[s] for s, _ in examples])[example]
    one_hot = np.eye(len(names))[target]
    held = example % 5 == 4 if len(examples) >= 5 * len(names) else np.zeros(len(rows), dtype=bool)
    flat = Rows.joined([r for _, r in texts])
    known = rows.take(~held)
    none_held = np.zeros((0, 3))
    model = SubjectModel(names, *_fit(known, one_hot[~held], np.ones(len(known)), buckets), np.zeros(len(names)), none_held)
    good = useful_hints(model, texts)
    hinted = np.zeros((len(flat), len(names)), dtype=bool)
    at = 0
    for hints, own in texts:
        for k, h in enumerate(hints):
            if (k, h) in good:
                hinted[at : at + len(own), index[h]] = True
        at += len(own)
    about_nothing = flat.take(np.zeros(0, dtype=np.int64))
    for _ in range(rounds if len(flat) else 0):
        z = model.scores(flat)
        order = np.sort(z, axis=1)
        top = z.argmax(axis=1)
        lead = order[:, -1] - order[:, -2] if len(names) > 1 else order[:, -1]
        sure = (lead >= margin) & (order[:, -1] > model.floor + 1.0) | hinted[np.arange(len(top)), top] & (order[:, -1] > model.floor)
        about_nothing = flat.take(order[:, -1] <= model.floor)
        more = flat.take(sure)
        extra = np.vstack([np.eye(len(names))[top[sure]], np.zeros((len(about_nothing), len(names)))])
        weight = np.concatenate([np.ones(len(known)), np.full(len(more) + len(about_nothing), 0.3)])
        model = SubjectModel(names, *_fit(Rows.joined([known, more, about_nothing]), np.vstack([one_hot[~held], extra]), weight, buckets), np.zeros(len(names)), none_held)
    z = model.scores(rows.take(held))
    kept = np.column_stack([target[held], z.argmax(axis=1), z.max(axis=1)]) if held.any() else none_held
    z = model.scores(about_nothing)
    nothing = np.column_stack([z.argmax(axis=1), z.max(axis=1), np.ones(len(z))]) if len(z) else np.zeros((0, 3))
    return replace(model, threshold=_thresholds(len(names), kept, nothing), held=kept)


def _thresholds(subjects: int, held: np.ndarray, nothing: np.ndarray) -> np.ndarray:
    """For each subject the score with the best F1 on held-out sentences and on sentences about nothing (leading subject, score, weight), of those where it leads; towards the lower end of about equal
    choices, as sentences in rarer languages score lower."""
    out = np.zeros(subjects)
    grid = np.linspace(-3.0, 3.0, 61)
    for k in range(subjects):
        true = held[:, 0] == k
        if not true.any():
            continue
        leads, false = held[:, 1] == k, nothing[:, 0] == k
        tp = ((true & leads) & (held[:, 2] >= grid[:, None])).sum(axis=1)
        hits = (leads & (held[:, 2] >= grid[:, None])).sum(axis=1) + ((nothing[false, 1] >= grid[:, None]) * nothing[false, 2]).sum(axis=1)
        f1 = 2 * tp / np.maximum(1, hits + true.sum())
        out[k] = np.quantile(grid[f1 >= f1.max() - 0.01], 0.2)
    # A threshold far above the others stems from a few odd sentences; the scores have one scale.
    return np.minimum(out, np.median(out))


def _hint(column: str):
    hint = F.lit(None).cast("string")
    for part, subject in HINTS.items():
        hint = F.coalesce(F.when(F.lower(column).contains(part), subject), hint)
    return hint


def model_for(documents: DataFrame, examples: DataFrame, most_examples: int = EXAMPLES, most_weak: int = WEAK_DOCUMENTS, most_sentences: int = WEAK_SENTENCES, doc_id: str = "doc_id", text: str = "text") -> SubjectModel:
    """``train`` on a bounded number of labelled texts, and of sentences of weakly labelled documents with what their source, kind and title hint at; all are chosen by hash, alike at every size.

    The documents are chosen by number, without their texts; their whole texts are then taken apart where they are, and only the chosen sentences' bucket numbers come to the driver.
    """
    given = examples.filter("subject is not null and text is not null")
    labelled = [(r["subject"], r["text"]) for r in given.select("subject", "text", F.xxhash64("text").alias("h")).orderBy("h", "subject").limit(most_examples).collect()]
    fields = [c for c in ("source", "doc_kind", "title") if c in documents.columns and c not in (doc_id, text)]
    drawn = documents.filter(F.length(text) > 0).select(F.xxhash64(text, doc_id).alias("h"), F.col(text).alias("text"), *[_hint(c).alias(f"hint{k}") for k, c in enumerate(fields)])
    last = drawn.select("h").distinct().orderBy("h").limit(most_weak).agg(F.max("h")).first()[0]
    if last is None:
        return train(labelled)

    def take_apart(batches):
        for b in batches:
            for part in slices(b, "text"):
                own = [(i, p) for i, t in enumerate(part["text"].to_pylist()) for p in _parts(t)]
                rows, which = Rows.of([p for _, p in own])
                fit = np.flatnonzero(rows.size <= LONG_SENTENCE)
                doc = pa.array(np.array([i for i, _ in own], dtype=np.int64)[which[fit]])
                rows = rows.take(fit)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows.size)]), pa.int32()), pa.array(rows.flat, pa.int32()))
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[part[n].take(doc) for n in names], pa.array(fit, pa.int64()), lists], [*names, "n", "row"])

    kinds = "".join(f"hint{k} string, " for k in range(len(fields)))
    texts = drawn.filter(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).mapInArrow(take_apart, f"h bigint, {kinds}n bigint, row array<int>")
    by_text: dict[tuple, list] = {}
    for r in texts.orderBy(F.xxhash64("h", "row"), "h").limit(most_sentences).collect():
        by_text.setdefault((r["h"], tuple(r[f"hint{k}"] for k in range(len(fields)))), []).append(r["row"])
    return train(labelled, [(hints, Rows.from_lists(lists)) for (_, hints), lists in sorted(by_text.items(), key=lambda kv: kv[0][0])])


def sentence_scores(documents: DataFrame, model: SubjectModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, top, score): for each document the leading subject's number and its score, sentence by sentence. Map-only; whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for piece in slices(b, text):
                own = [_parts(t) if t else [] for t in piece[text].to_pylist()]
                rows, which = Rows.of([p for parts in own for p in parts], model.weights.shape[0])
                doc = np.repeat(np.arange(len(own)), [len(parts) for parts in own])[which]
                z = model.scores(rows)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(own)))]), pa.int32())
                top = pa.ListArray.from_arrays(ends, pa.array(z.argmax(axis=1) if len(z) else [], pa.int32()))
                score = pa.ListArray.from_arrays(ends, pa.array(z.max(axis=1) if len(z) else [], pa.float64()))
                yield pa.RecordBatch.from_arrays([piece[doc_id], top, score], [doc_id, "top", "score"])

    return documents.select(doc_id, text).mapInArrow(run, f"{doc_id} {dict(documents.dtypes)[doc_id]}, top array<int>, score array<double>")


def calibrated(model: SubjectModel, scored: DataFrame, bin_width: float = 0.1, window: int = 5) -> SubjectModel:
    """The model with one threshold, set by the scores of all documents' sentences: where they are fewest (over ``window`` bins), between what the biases alone give and the low end of held-out sentences; the
    lowest such place, as sentences in rarer languages score lower. Leading scores have one scale for all subjects. Without held-out sentences the model is returned as it is."""
    if not len(model.held):
        return model
    high = float(np.quantile(model.held[:, 2], 0.05))
    pair = F.explode("score").alias("s")
    first, last = int(np.floor(model.floor / bin_width)), int(np.ceil(high / bin_width))
    if last <= first:
        return model
    counts = np.zeros(last - first + 1)
    for r in scored.select(pair).groupBy(F.floor(F.col("s") / bin_width).alias("b")).agg(F.count("*").alias("n")).filter(F.col("b").between(first, last)).collect():
        counts[r["b"] - first] = r["n"]
    width = min(window, len(counts))
    sums = np.convolve(counts, np.ones(width), "valid")
    least = (first + int(sums.argmin()) + width / 2) * bin_width
    return replace(model, threshold=np.full(len(model.subjects), least))


def subject_shares(documents: DataFrame, model: SubjectModel, doc_id: str = "doc_id", text: str = "text", scored: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, share, sentences): for each document and subject with any sentence about it, the share of all its sentences. Map-only; whole texts."""
    scored = sentence_scores(documents, model, doc_id, text) if scored is None else scored
    about = lambda k: F.size(F.filter(F.arrays_zip("top", "score"), lambda s: (s["top"] == k) & (s["score"] >= float(model.threshold[k]))))
    n = F.size("top")
    each = F.array(*[F.struct(F.lit(name).alias("subject"), (about(k) / n).alias("share"), n.alias("sentences")) for k, name in enumerate(model.subjects)])
    return scored.filter(n > 0).select(doc_id, F.explode(F.filter(each, lambda s: s["share"] > 0)).alias("s")).select(doc_id, "s.subject", "s.share", "s.sentences")


def subjects_of(documents: DataFrame, examples: DataFrame, share: float = SHARE, model: SubjectModel | None = None) -> DataFrame:
    """(doc_id, subject, share, sentences) with at least ``share`` of the sentences; a document may have none, one or more subjects.

    All sentences are scored in one pass over whole texts; thresholds come from all of them (``calibrated``), unless a model with its own is given.
    Null and empty texts have none. Sentences of markup, numbers or single words aren't counted.
    """
    fitted = model or model_for(documents, examples)
    scored = sentence_scores(documents, fitted)
    if model is None:
        scored = materialize(scored, "scores")
        fitted = calibrated(fitted, scored)
    return subject_shares(documents, fitted, scored=scored).filter(F.col("share") >= share - 1e-9)


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents have each subject; with the row "none" for those without any."""
    total = documents.count()
    by = found.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))
    none = documents.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.lit("none").alias("subject"), F.count("*").alias("documents"))
    return by.unionByName(none.select("subject", "documents")).withColumn("share", F.col("documents") / F.lit(max(total, 1)))
