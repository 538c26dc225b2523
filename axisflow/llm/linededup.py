"""Repeated lines: two Bloom filters find suspects, only suspects are shuffled, counts are exact."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import columns_of, put, worker_cache

SPACE = b" \t\n\x0b\x0c\r"
SEGMENTS = 256            # slices of the hash range; each has its own pair of filters
MAX_FILTER_BYTES = 1 << 26  # all twice-seen filters together; a fuller filter only suspects more lines
MAX_DROPPED_KEYS = 400_000  # confirmed keys that are broadcast as 16-byte digests; beyond it they are joined
FLUSH = 400_000           # hashes or keys that a task holds before it emits them


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def _keys(text: bytes, min_chars: int) -> list[bytes]:
    """A key for each line; an empty key for lines that are too short to count."""
    worker_cache("linededup")
    keys = list(map(line_key, text.split(b"\n")))
    if min_chars > 1:
        keys = [k if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else b"" for k in keys]
    return keys


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def _segment(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (SEGMENTS - 1).bit_length())).astype(np.int64)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return (h & m).astype(np.int64), ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & m).astype(np.int64)


def _seen(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(_segment(h), np.arange(SEGMENTS + 1))
            rows = [(s, int(b - a), h[a:b][n[a:b] == 1].tobytes(), h[a:b][n[a:b] > 1].tobytes())
                    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            held.clear()
            cols = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                              ["segment", "n", "once", "twice"])

        size = 0
        for batch in batches:
            for text in _texts(batch.column(0)):
                keys = set(_keys(text, min_chars))
                keys.discard(b"")
                if keys:
                    held.append(_hashes(keys))
                    size += len(keys)
            if size >= FLUSH:
                yield out()
                size = 0
        if held:
            yield out()
    return run


def _filter(bits_of: dict[int, int]):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of[key[0].as_py()]
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            for one, two in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                for h, sure in ((np.frombuffer(one, np.uint64), False), (np.frombuffer(two, np.uint64), True)):
                    a, b = _places(h, bits)
                    again = np.ones(len(h), bool) if sure else once[a] & once[b]
                    twice[a[again]] = twice[b[again]] = True
                    once[a] = once[b] = True
        packed = np.packbits(twice, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], ["segment", "bits"])
    return run


class _Suspects:
    """The twice-seen filters in one array of bytes, looked up by hash."""

    def __init__(self, filters: dict[int, bytes]):
        sizes = np.array([len(filters.get(s, b"")) for s in range(SEGMENTS)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.bits = sizes * 8
        self.data = np.frombuffer(b"".join(filters.get(s, b"") for s in range(SEGMENTS)), np.uint8)

    def __contains__(self, key: bytes) -> bool:
        return bool(self.of([key])[0])

    def of(self, keys: list[bytes]) -> np.ndarray:
        h = _hashes(keys)
        s = _segment(h)
        out = np.zeros(len(h), bool)
        known = self.bits[s] > 0
        if known.any():
            h, s = h[known], s[known]
            m = (self.bits[s] - 1).astype(np.uint64)
            a = (h & m).astype(np.int64)
            b = ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & m).astype(np.int64)
            bit = lambda p: (self.data[self.start[s] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1
            out[known] = (bit(a) & bit(b)).astype(bool)
        return out


def twice_seen(texts: DataFrame, min_chars: int) -> _Suspects:
    """Filters of the keys that occur in two texts or more; false positives only, never a miss.

    Tasks emit their distinct hashes by segment, so a line that a third of all texts share is one
    hash per task. A segment's filter has 16 bits a hash, up to its share of MAX_FILTER_BYTES.
    """
    seen = cut_lineage(texts.mapInArrow(_seen(min_chars), "segment int, n long, once binary, twice binary"))
    top = MAX_FILTER_BYTES * 8 // SEGMENTS
    bits_of = {r.segment: min(top, max(1 << 10, 1 << int(16 * r.n - 1).bit_length())) for r in seen.groupBy("segment").agg(F.sum("n").alias("n")).collect()}
    made = seen.groupBy("segment").applyInArrow(_filter(bits_of), "segment int, bits binary")
    return _Suspects({r.segment: bytes(r.bits) for r in made.collect()})


def _count(suspects, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        first: dict = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            got = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([held[k] for k in keys], pa.int64()), pa.array([first[k] for k in keys], pa.int64())], ["key", "n", "first_id"])
            held.clear()
            first.clear()
            return got

        for batch in batches:
            keys, owner = [], []
            for i, text in enumerate(_texts(batch.column(0))):
                own = set(_keys(text, min_chars))
                own.discard(b"")
                keys += own
                owner += [i] * len(own)
            if not keys:
                continue
            ids = batch.column(1).to_pylist()
            for j in np.flatnonzero(suspects.value.of(keys)):
                k, doc = keys[j], ids[owner[j]]
                held[k] += 1
                if k not in first or first[k] is None or (doc is not None and doc < first[k]):
                    first[k] = doc
            if len(held) >= FLUSH:
                yield out()
        if held:
            yield out()
    return run


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"):
    """(key, n, first_id) of the line keys found in at least ``min_docs`` documents, and the filters that found them.

    Only keys that the twice-seen filters hold leave a task, once per task with their count.
    """
    texts = columns_of(docs, text_col, id_col).select(F.col(text_col), F.col(id_col).cast("long"))
    suspects = docs.sparkSession.sparkContext.broadcast(twice_seen(texts, min_chars))
    counted = texts.mapInArrow(_count(suspects, min_chars), "key binary, n long, first_id long")
    found = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id")).where(F.col("n") >= min_docs)
    return cut_lineage(found), suspects


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


RESULT = "text string, n_lines long, n_dropped long"


def _strip(text: bytes, own, gone) -> tuple[str, int, int]:
    lines = text.split(b"\n")
    kept = [x for i, (x, k) in enumerate(zip(lines, own)) if not (k and gone(i, k))]
    return b"\n".join(kept).decode("utf-8", "replace"), len(lines), len(lines) - len(kept)


def _drop_known(suspects, known, min_chars: int, keep_first: bool):
    @F.pandas_udf(RESULT)
    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = []
        table = known.value
        for text, doc in zip(texts, ids):
            raw = (text or "").encode()
            own = _keys(raw, min_chars)
            real = [k for k in own if k]
            maybe = {k for k, m in zip(real, suspects.value.of(real)) if m} if real else ()
            met: set = set()

            def gone(i, k, doc=doc, maybe=maybe, met=met):
                if k not in maybe:
                    return False
                d = _digest(k)
                if d not in table:
                    return False
                if keep_first and table[d] is not None and table[d] == doc and k not in met:
                    met.add(k)
                    return False
                return True
            rows.append(_strip(raw, own, gone))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])
    return run.asNondeterministic()  # else a filter on the result runs it once more, in a second worker beside the first


def _suspected(suspects, min_chars: int):
    @F.pandas_udf("array<struct<line:int,key:binary>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            own = _keys((text or "").encode(), min_chars)
            at = [i for i, k in enumerate(own) if k]
            real = [own[i] for i in at]
            out.append([{"line": i, "key": k} for i, k, m in zip(at, real, suspects.value.of(real)) if m] if real else [])
        return pd.Series(out)
    return run


def _drop_lines():
    @F.pandas_udf(RESULT)
    def run(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, g in zip(texts, gone):
            raw = (text or "").encode()
            drop = set() if g is None else {int(x) for x in g}
            rows.append(_strip(raw, [b"x"] * (raw.count(b"\n") + 1), lambda i, _, drop=drop: i in drop))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])
    return run.asNondeterministic()


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text",
               max_broadcast: int = MAX_DROPPED_KEYS) -> DataFrame:
    """``docs`` with the text stripped of lines found in ``min_docs`` documents, plus ``n_lines`` (before) and ``n_dropped``.

    Two lines are the same if their keys are: white space at the ends gone, A-Z lower-cased. Keys shorter than
    ``min_chars`` code points are never dropped. With ``keep_first`` the first such line of the document with the
    least id stays (of every row with that id, should it repeat).

    Null or empty texts count as one empty line and come back empty. A document counts once for a key however often
    it holds it; repeated rows are documents of their own, null ids too. Input columns called ``n_lines`` or
    ``n_dropped`` give way; all others stay. An empty table gives an empty table.
    """
    found, suspects = repeated_lines(docs, min_docs, min_chars, id_col, text_col)
    have = {c.lower(): c for c in docs.columns}
    text, ident = F.col(f"`{have[text_col.lower()]}`"), F.col(f"`{have[id_col.lower()]}`").cast("long")
    few = found.limit(max_broadcast + 1).count() <= max_broadcast
    if few:
        known = {_digest(bytes(r.key)): r.first_id for r in found.select("key", "first_id").toLocalIterator()}
        known = docs.sparkSession.sparkContext.broadcast(known)
        done = docs.withColumn("_line_dedup", _drop_known(suspects, known, min_chars, keep_first)(text, ident))
    else:
        mark = put(docs, _line_mark=F.xxhash64(text, F.lit(1)), _line_mark2=F.xxhash64(F.lit(7), text), _line_id=ident)
        lines = mark.select("_line_id", "_line_mark", "_line_mark2", F.explode(_suspected(suspects, min_chars)(text)).alias("s")).select("_line_id", "_line_mark", "_line_mark2", "s.line", "s.key")
        hit = lines.join(found.select("key", "first_id"), "key")
        if keep_first:
            first = hit.where(F.col("first_id").eqNullSafe(F.col("_line_id")) & F.col("_line_id").isNotNull()).groupBy("_line_id", "_line_mark", "_line_mark2", "key").agg(F.min("line").alias("line"))
            hit = hit.join(first, (hit["_line_id"] == first["_line_id"]) & (hit["_line_mark"] == first["_line_mark"]) & (hit["_line_mark2"] == first["_line_mark2"]) & (hit["key"] == first["key"]) & (hit["line"] == first["line"]), "left_anti")
        gone = hit.groupBy("_line_id", "_line_mark", "_line_mark2").agg(F.collect_set("line").alias("_line_gone")).select(*[F.col(c).alias(f"{c}r") for c in ("_line_id", "_line_mark", "_line_mark2")], "_line_gone")
        joined = mark.join(gone, F.col("_line_id").eqNullSafe(F.col("_line_idr")) & (F.col("_line_mark") == F.col("_line_markr")) & (F.col("_line_mark2") == F.col("_line_mark2r")), "left")
        done = joined.withColumn("_line_dedup", _drop_lines()(text, F.col("_line_gone"))).drop("_line_id", "_line_mark", "_line_mark2", "_line_idr", "_line_markr", "_line_mark2r", "_line_gone")
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    done = put(done, **{have[text_col.lower()]: F.col("_line_dedup.text"), "n_lines": F.col("_line_dedup.n_lines"), "n_dropped": F.col("_line_dedup.n_dropped")})
    return done.select(*[F.col(f"`{c}`") for c in order], "n_lines", "n_dropped")
