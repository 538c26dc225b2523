"""Packing token sequences: a cutting-stock plan over the histogram of lengths, applied to ranked pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import columns_of
from .tokens import VOCAB, id_bytes

GRAIN = 16          # tokens a length class is wide
COLUMNS = 40        # patterns that one pricing adds at most
GAP = 1e-3          # relative distance from the lower bound at which the linear program is good enough
PER_BUCKET = 20_000  # pieces that are ranked together


def token_pieces(docs: DataFrame, capacity: int, vocab: str, end_id: int | None, by_piece: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces of ``capacity`` ids, then the rest of the document."""
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = id_bytes(vocab, by_piece)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start:4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_patterns(values: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Unbounded knapsack by dynamic programming: for every item size, the best pattern that has it, best first.

    ``values[s - 1]`` is the worth of an item of size ``s``. Patterns worth no more than 1 are left out.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = best[room - 1::-1][:room] + values[:room]
        s = int(gain.argmax())
        if gain[s] > best[room - 1] + 1e-12:
            best[room], take[room] = gain[s], s + 1
        else:
            best[room] = best[room - 1]
    worth = values + best[capacity - 1::-1]
    found = []
    for s in np.argsort(-worth, kind="stable"):
        if worth[s] <= 1 + 1e-7 or len(found) == COLUMNS:
            break
        if values[s] <= 0:
            continue
        pattern, room = np.zeros(capacity, np.int64), capacity - s - 1
        pattern[s] = 1
        while room > 0:
            if take[room]:
                pattern[take[room] - 1] += 1
                room -= take[room]
            else:
                room -= 1
        found.append(pattern)
    return found


def fractional_plan(demand: np.ndarray, max_pivots: int = 20_000) -> tuple[list[np.ndarray], np.ndarray]:
    """Column generation for ``min sum(x)`` with patterns that meet the demand of every length class.

    ``demand[s - 1]`` items of size ``s`` go into bins of ``len(demand)``. The basis starts with one pattern per
    class; duals price new patterns by knapsack; each pivots in while its worth is above 1. It ends when no pattern
    is, or when the sum is within ``GAP`` of a lower bound: all sizes over the capacity, or the sum over the best worth.
    """
    capacity = len(demand)
    rows = np.flatnonzero(demand)
    patterns = []
    for s in rows:
        p = np.zeros(capacity, np.int64)
        p[s] = capacity // (s + 1)
        patterns.append(p)
    if not patterns:
        return [], np.zeros(0)
    inverse = np.diag([1.0 / p[s] for p, s in zip(patterns, rows)])
    need = demand[rows].astype(float)
    times = lambda v: (inverse * v).sum(axis=1)  # noqa: E731  small products stay off threaded libraries
    x, pivots = times(need), 0
    low = float(((np.arange(capacity) + 1) * demand).sum()) / capacity
    while pivots < max_pivots and x.sum() > low * (1 + GAP):
        duals = inverse.sum(axis=0)
        values = np.zeros(capacity)
        values[rows] = np.maximum(duals, 0)
        new = best_patterns(values, capacity)
        if not new:
            break
        low = max(low, x.sum() / float(new[0] @ values))
        for pattern in new:
            if float(pattern[rows] @ duals) <= 1 + 1e-7:
                continue
            column = times(pattern[rows])
            ahead = column > 1e-9
            if not ahead.any():
                continue
            ratio = np.full(len(x), np.inf)
            ratio[ahead] = np.maximum(x[ahead], 0) / column[ahead]
            out = int(ratio.argmin())
            line = inverse[out] / column[out]
            column[out] = 0
            inverse -= np.outer(column, line)
            inverse[out] = line
            patterns[out] = pattern
            pivots += 1
            x = times(need)
            duals = inverse.sum(axis=0)
    return patterns, np.maximum(x, 0)


def integer_plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole copies that hold every item: the plan rounded down, the rest packed first-fit decreasing.

    The rest is below one copy per pattern, so its size is bounded by the number of classes, not by the items.
    """
    patterns, x = fractional_plan(demand)
    plan, rest = [], demand.astype(np.int64).copy()
    for p, n in zip(patterns, np.floor(x + 1e-6).astype(np.int64)):
        used = p > 0
        n = min(int(n), int((rest[used] // p[used]).min())) if used.any() else 0
        if n > 0:
            plan.append((p, n))
            rest -= p * n
    while rest.any():
        pattern, room = np.zeros(len(demand), np.int64), len(demand)
        for s in range(len(demand), 0, -1):
            n = min(int(rest[s - 1]), room // s)
            if n:
                pattern[s - 1] += n
                room -= n * s
        used = pattern > 0
        copies = int((rest[used] // pattern[used]).min())
        plan.append((pattern, copies))
        rest -= pattern * copies
    return plan


def _slots(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class, by rank: where a pattern's share begins, its first sequence, its items per sequence and their first slot."""
    made: dict[int, list] = {}
    base = 0
    for pattern, copies in plan:
        slot = 0
        for c in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[c])
            made.setdefault(int(c), []).append((n * copies, base, n, slot))
            slot += n
        base += copies
    out = {}
    for c, parts in made.items():
        sizes = np.array([p[0] for p in parts], np.int64)
        out[c] = (np.concatenate([[0], np.cumsum(sizes)[:-1]]), *(np.array([p[i] for p in parts], np.int64) for i in (1, 2, 3)))
    return out


def pack(docs: DataFrame, capacity: int = 4096, vocab: str = VOCAB, end_id: int | None = 2, by_piece: bool = True, grain: int = GRAIN,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents laid into sequences of at most ``capacity`` ids.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32 (of its ids, little-endian, 32 bits),
    doc_tokens, sequence_id, offset (gapless from 0 in its sequence). ``end_id`` is appended to every document, so a null
    or empty text is a piece of that one id; with ``end_id=None`` such a document has no piece.

    Documents longer than ``capacity`` are cut at its multiples. The histogram of lengths, in classes of ``grain``
    tokens, is all that reaches the driver; the linear program over it is solved by column generation. A piece's rank
    in its class, added up from counts of hashed buckets, finds its sequence in the rounded plan.

    Repeated rows and ids are pieces of their own. Other input columns are not returned. An empty table gives an empty table.
    """
    found = cut_lineage(token_pieces(docs, capacity, vocab, end_id, by_piece, id_col, text_col))
    found = found.withColumn("_class", F.expr(f"(length + {grain - 1}) div {grain} - 1").cast("int"))
    histogram = found.groupBy("_class").agg(F.count("*").alias("n")).collect()
    demand = np.zeros(capacity // grain, np.int64)
    for r in histogram:
        demand[r["_class"]] = r.n
    slots = docs.sparkSession.sparkContext.broadcast(_slots(integer_plan(demand)))
    buckets = max(1, -(-int(demand.sum()) // PER_BUCKET))

    found = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = found.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_class", "_bucket", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = found.withColumn("_rank", rank).join(before, ["_class", "_bucket"])

    @F.pandas_udf("sequence_id long, slot long")
    def place(kind: pd.Series, at: pd.Series) -> pd.DataFrame:
        kind, at = kind.to_numpy(), at.to_numpy()
        sequence, slot = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for c in np.unique(kind):
            own = kind == c
            begin, base, each, first = slots.value[int(c)]
            j = np.searchsorted(begin, at[own], "right") - 1
            k = at[own] - begin[j]
            sequence[own], slot[own] = base[j] + k // each[j], first[j] + k % each[j]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("_at", place("_class", F.col("_rank") + F.col("_before"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.slot").alias("_slot"))
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("_slot")
