"""Filling containers of fixed capacity with whole texts."""

from __future__ import annotations

import bisect
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.constants import BROADCAST_ROWS
from grovewise.plans.bounded import broadcast_bounded
from grovewise.plans.ranking import Sorted
from grovewise.session import materialize

#: A public vocabulary; every executor reads it from this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048
#: Characters encoded at once: a longer text is cut behind white space, where no token of a byte-level vocabulary crosses.
CHUNK = 200_000

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def _chunks(text: str, most: int = CHUNK):
    start = 0
    while len(text) - start > most:
        cut = max(text.rfind(" ", start + 1, start + most), text.rfind("\n", start + 1, start + most))
        cut = cut if cut > start else start + most
        yield text[start:cut]
        start = cut
    yield text[start:]


def token_counts(df: DataFrame, text: str, tokens: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of its whole text; null for a null text, 0 for an empty one."""
    columns = df.columns
    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes if c != tokens)

    def run(batches):
        t = _tokenizer(path)
        for b in batches:
            texts = b[text].to_pylist()
            parts = [(i, c) for i, x in enumerate(texts) if x is not None for c in _chunks(x)]
            counts = [None if x is None else 0 for x in texts]
            for at in range(0, len(parts), 256):
                some = parts[at : at + 256]
                for (i, _), e in zip(some, t.encode_batch_fast([c for _, c in some], add_special_tokens=False)):
                    counts[i] += len(e)
            kept = [c for c in columns if c != tokens]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(counts, pa.int64())], [*kept, tokens])

    return df.mapInArrow(run, f"{schema}, {tokens} bigint")


def pieces_of(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(item_id, piece, start, size): one whole piece of each item, but for items above the capacity, cut into full pieces and a rest.

    Null sizes give none; an item of size 0 or below is one empty piece.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / capacity)).cast("int")
    out = items.filter(F.col(size).isNotNull()).select(F.col(item_id), F.col(size).alias("_s"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return out.select(item_id, "piece", start.alias("start"), F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("_s") - start)).cast("int").alias("size"))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, bulk by bulk: (size, first rank, pieces, first container, pieces for each container).

    Pieces and gaps are held as sorted runs: for a size how many pieces, for a gap which ranges of containers. A step takes all pieces of the
    largest size left and sweeps from their smallest sufficient gap upwards; pieces and containers of one step are matched by rank, so that no two claim a place twice; then the
    gaps are updated and the next step begins. The result is that of placing the pieces one by one, largest first, each into the smallest gap that holds it.
    State and steps depend on the number of distinct sizes (at most the capacity), not on the number of pieces.
    """
    gaps: list[int] = []  # sorted distinct gaps
    ranges: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def free(gap: int, start: int, n: int) -> None:
        if gap > 0 and n:
            if gap not in ranges:
                bisect.insort(gaps, gap)
                ranges[gap] = []
            if ranges[gap] and sum(ranges[gap][-1]) == start:
                ranges[gap][-1] = (ranges[gap][-1][0], ranges[gap][-1][1] + n)
            else:
                ranges[gap].append((start, n))

    def fill(size: int, rank: int, left: int, start: int, n: int, gap: int) -> int:
        """Put pieces into n containers of one gap, as many as fit into each; gives how many were put."""
        each = gap // size
        full = min(n, left // each)
        if full:
            out.append((size, rank, full * each, start, each))
            free(gap - each * size, start, full)
        put = full * each
        if full < n and left > put:  # the last container takes what is left
            out.append((size, rank + put, left - put, start + full, left - put))
            free(gap - (left - put) * size, start + full, 1)
            put, full = left, full + 1
        if full < n:
            free(gap, start + full, n - full)
        return put

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        if size <= 0:  # an empty piece needs no room: all of them share the first container
            containers = max(containers, 1)
            out.append((size, 0, left, 0, left))
            continue
        while left:
            k = bisect.bisect_left(gaps, size)
            if k == len(gaps):
                each = capacity // size
                n = -(-left // each)
                rank, left = rank + fill(size, rank, left, containers, n, capacity), 0
                containers += n
                continue
            gap = gaps[k]
            taken = ranges[gap]
            start, n = taken.pop(0)
            if not taken:
                del ranges[gap]
                gaps.pop(k)
            put = fill(size, rank, left, start, n, gap)
            rank, left = rank + put, left - put
    return out


def pack(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(item_id, piece, start, size, container): every item in containers of ``capacity``, whole unless it exceeds the capacity.

    1. Pieces are range-sorted by size over all partitions, and counted for each size.
    2. The counts, at most one for each size up to the capacity whatever the number of items, are swept as in ``sweep``.
    3. Each piece's rank within its size comes from per-partition counts; rank and size lead it to its container through the sweep's runs.

    No task or driver holds the items of one size or one container, and no round passes over the items again. Ids may repeat (each row is an item then). Containers are numbered from 0.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    order = Sorted(pieces_of(items, item_id, size, capacity), ["size"], [item_id, "piece"])
    counts = {r["size"]: r["n"] for r in order.pieces.groupBy("size").agg(F.max("_total").alias("n")).collect()}
    runs = sweep(counts, capacity)
    spark = items.sparkSession
    plan = pa.table({k: pa.array([r[i] for r in runs], pa.int64()) for i, k in enumerate(("_size", "_from", "_n_run", "_container", "_each"))})
    placed = spark.createDataFrame(plan)
    ranked = order.ranked("_rank")
    # Runs of one size follow one another by rank; a bucket of ranks narrows the range condition to an equality.
    on = (F.col("size") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n_run"))
    out = ranked.join(broadcast_bounded(placed, BROADCAST_ROWS), on)
    container = F.col("_container") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each"))
    return out.select(item_id, "piece", "start", "size", container.cast("long").alias("container"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, pieces, tokens, and the share of room unused."""
    each = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    total = each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return total.withColumn("unused", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)))


def packed_documents(documents: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` of the documents' whole texts by their tokens."""
    sizes = materialize(token_counts(documents.select("doc_id", "text"), "text", path=path).select("doc_id", "tokens"), "tokens")
    return pack(sizes, "doc_id", "tokens", capacity)
