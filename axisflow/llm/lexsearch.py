"""Ranked lexical search over an index with per-term geometric blocking.

Documents are indexed in segments of bounded size, each a row of a table. Inside a segment the posting list of a term
is clustered by the similarity of its documents into blocks, and every block keeps the coordinatewise maximum of its
documents' impacts. A query reads its lists by falling bound, stops when the lists left cannot reach the score to
beat, and skips a block only if the exact bound of its summary stays below that score. What is left is scored from
the documents' own vectors, so results are exact.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..session import cut_lineage, staging_path
from .common import columns_of, give_back

K1000, B100 = 8, 90             # saturation by length: tf / (tf + 0.8 * relative length), nine tenths of it by length
SEGMENT_DOCS = 4_096            # documents of a segment at most
SEGMENT_POSTINGS = 500_000      # postings of a segment at most, but for one longer document
SHORT = 512                     # posting lists up to this are one block without a summary
BLOCK = 1_024                   # documents of a block at most
DIMS = 64                       # of the sketches that documents are compared by
CENTRES = 64                    # documents of a segment that blocks gather around
VOCABULARY = 2_000_000          # query terms, and
VOCABULARY_BYTES = 64_000_000   # their bytes, that are broadcast to index only their coordinates; all terms beyond
QUERY_BLOCK = 10_000            # queries, and
QUERY_BYTES = 64_000_000        # bytes of their terms, that pass over the index at once

#: Bytes of UTF-8 that belong to terms, A-Z lowered; all others separate. Bytes from 0x80 are parts of other characters.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


# ---------------------------------------------------------------- documents as term counts

def _counted(vocabulary):
    """Rows (id, text) to (id, n, terms, tfs): the terms of a text in all, and its distinct ones of the vocabulary with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if vocabulary is None else vocabulary.value
        for batch in batches:
            ns, flat, tfs, ends = [], [], [], [0]
            for x in batch.column(1):
                found = terms_of(x.as_py())
                counts = Counter(found)
                hits = sorted(counts if wanted is None else counts.keys() & wanted)
                ns.append(len(found))
                flat += hits
                tfs += [counts[t] for t in hits]
                ends.append(len(flat))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))],
                                             names=["id", "n", "terms", "tfs"])
        give_back()
    return run


def counted(df: DataFrame, id_col: str, text_col: str, vocabulary=None) -> DataFrame:
    """(id, n, terms, tfs) of each row."""
    rows = columns_of(df, id_col, text_col)
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(_counted(vocabulary), f"id {kind}, n long, terms array<string>, tfs array<int>")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, terms): the distinct terms of each query row."""
    return counted(queries, id_col, text_col).select(F.col("id").alias("query"), "terms")


def _vocabulary(asked: DataFrame):
    """The distinct query terms as a broadcast set if they are few enough; nothing, for all terms, otherwise."""
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    size = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if size[0] > VOCABULARY or size[1] > VOCABULARY_BYTES:
        return None
    return asked.sparkSession.sparkContext.broadcast(frozenset(r.term.encode() for r in terms.collect()))


# ---------------------------------------------------------------- segments

SEGMENT = "n_docs int, n_postings int, n_blocks int, segment binary"
ARRAYS = ("doc_ids", "no_id", "ptr", "cols", "impacts", "list_blocks", "block_ptr", "block_docs", "block_max", "sum_ptr", "sum_cols", "sum_max")
KINDS = {"doc_ids": np.int64, "no_id": np.bool_}


@dataclass
class Segment:
    """Vectors of documents by row (ptr, cols, impacts); blocks of each term's list; summaries of blocks, empty for short lists."""

    terms: list[str]
    doc_ids: np.ndarray
    no_id: np.ndarray
    ptr: np.ndarray
    cols: np.ndarray
    impacts: np.ndarray
    list_blocks: np.ndarray  # first block of each term, and the number of blocks at the end
    block_ptr: np.ndarray
    block_docs: np.ndarray
    block_max: np.ndarray    # greatest impact of the block's own term
    sum_ptr: np.ndarray
    sum_cols: np.ndarray
    sum_max: np.ndarray
    place: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.place = {t: i for i, t in enumerate(self.terms)}

    def row(self) -> pa.RecordBatch:
        """One row of the index: the arrays as a compressed Arrow stream, so a reader holds them packed until it needs them."""
        lists = [pa.array([self.terms], pa.list_(pa.string()))]
        for name in ARRAYS:
            flat = pa.array(getattr(self, name).astype(KINDS.get(name, np.int32)))
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        packed, out = pa.RecordBatch.from_arrays(lists, names=["terms", *ARRAYS]), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(packed)
        sizes = [len(self.doc_ids), len(self.cols), len(self.block_max)]
        return pa.RecordBatch.from_arrays([*[pa.array([n], pa.int32()) for n in sizes], pa.array([out.getvalue().to_pybytes()], pa.binary())],
                                          names=["n_docs", "n_postings", "n_blocks", "segment"])

    @classmethod
    def read(cls, packed: bytes) -> "Segment":
        with pa.ipc.open_stream(packed) as stream:
            batch = stream.read_next_batch()
        get = lambda name: batch.column(name)[0].values
        return cls(terms=get("terms").to_pylist(), **{name: get(name).to_numpy(zero_copy_only=False) for name in ARRAYS})


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of many ranges one after the other, and where each range starts among them."""
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    return np.repeat(starts - first, size) + np.arange(size.sum()), first


def impact(tf, n, docs: int, length: int):
    """A term's share of a score before its weight, in whole numbers."""
    m = 100 - B100 + (B100 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + K1000 * m)


def _similarities(ptr: np.ndarray, cols: np.ndarray, impacts: np.ndarray, n_terms: int) -> np.ndarray:
    """Cosines between sketches of all documents of a segment and those of evenly chosen centres."""
    docs = len(ptr) - 1
    owner = np.repeat(np.arange(docs), np.diff(ptr))
    rarity = np.log1p(docs / np.maximum(np.bincount(cols, minlength=n_terms), 1))
    mixed = (np.arange(n_terms, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    dim, sign = (mixed % np.uint64(DIMS)).astype(np.int64), np.where((mixed >> np.uint64(12)) & np.uint64(1), 1.0, -1.0)
    at = np.bincount(owner * DIMS + dim[cols], weights=impacts * (rarity * sign)[cols], minlength=docs * DIMS).reshape(docs, DIMS)
    at /= np.maximum(np.sqrt((at * at).sum(1, keepdims=True)), 1e-9)
    centres = at[np.linspace(0, docs - 1, min(docs, CENTRES)).astype(int)]
    return np.einsum("id,jd->ij", at.astype(np.float32), centres.astype(np.float32))


def _blocks(members: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """A posting list cut into clusters of documents near the same centre, at most ``BLOCK`` of them in a block."""
    wanted = -(-len(members) // BLOCK) + 1
    own = near[members]
    chosen = np.argpartition(-own.sum(0), min(wanted, own.shape[1]) - 1)[:wanted]
    cluster = own[:, chosen].argmax(1)
    out = []
    for c in range(len(chosen)):
        some = members[cluster == c]
        out += [some[i:i + BLOCK] for i in range(0, len(some), BLOCK)]
    return out


def build(doc_ids, no_id, ns, terms: pa.Array, tfs: np.ndarray, sizes: np.ndarray, docs: int, length: int) -> Segment:
    """A segment of documents with ``sizes`` postings each, whose terms and counts follow each other."""
    coded = terms.dictionary_encode()
    names, cols = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    impacts = impact(tfs.astype(np.int64), np.repeat(ns, sizes), docs, length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(cols, kind="stable")
    lists = np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=len(names)))])
    by_term, impact_by_term = owner[order], impacts[order]
    near = _similarities(ptr, cols, impacts, len(names)) if len(names) and np.diff(lists).max() > SHORT else None

    own = np.zeros(len(names), impacts.dtype)
    list_blocks, blocks, block_max, sum_size, sum_cols, sum_max = [0], [], [], [], [], []
    for t in range(len(names)):
        members = by_term[lists[t]:lists[t + 1]]
        if len(members) <= SHORT:
            blocks.append(members)
            block_max.append(impact_by_term[lists[t]:lists[t + 1]].max())
            sum_size.append(0)
        else:
            for some in _blocks(members, near):
                at, _ = spans(ptr[some], ptr[some + 1])
                own[:] = 0
                np.maximum.at(own, cols[at], impacts[at])
                held = np.flatnonzero(own)
                blocks.append(some)
                block_max.append(own[t])
                sum_size.append(len(held))
                sum_cols.append(held.astype(np.int32))
                sum_max.append(own[held].astype(np.int32))
        list_blocks.append(len(blocks))
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Segment(names, np.asarray(doc_ids), np.asarray(no_id), ptr, cols, impacts, np.array(list_blocks), np.cumsum([0, *map(len, blocks)]), joined(blocks),
                   np.array(block_max, dtype=np.int64), np.cumsum([0, *sum_size]), joined(sum_cols), joined(sum_max))


def _segments(docs: int, length: int):
    """Rows (doc_id, n, terms, tfs) of a task as segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_postings = [], 0, 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            one = lambda c: table.column(c).chunk(0)
            ids, lists = one("doc_id"), one("terms")
            sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
            return build(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), one("n").to_numpy(zero_copy_only=False),
                         lists.flatten(), one("tfs").flatten().to_numpy(zero_copy_only=False), sizes, docs, length).row()

        for batch in batches:
            sizes, start = np.asarray(pa.compute.list_value_length(batch.column("terms"))), 0
            for i, size in enumerate(sizes):
                if n_docs and (n_docs >= SEGMENT_DOCS or n_postings + size > SEGMENT_POSTINGS):
                    held.append(batch.slice(start, i - start))
                    yield made()
                    give_back()
                    n_docs, n_postings, start = 0, 0, i
                n_docs, n_postings = n_docs + 1, n_postings + int(size)
            held.append(batch.slice(start))
        if n_docs:
            yield made()
        give_back()
    return run


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """At most ``rows`` rows go to Python at once while a plan runs; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


@dataclass
class Index:
    """A written index: its folder, the number of documents with a term, their terms in all, and the terms it is limited to."""

    spark: SparkSession
    at: str
    docs: int
    length: int

    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT).parquet(f"{self.at}/segments")

    def frequencies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/frequencies")


def build_index(docs: DataFrame, vocabulary=None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row; with a broadcast ``vocabulary`` only its terms are coordinates, which changes no score of a query made of them.

    Texts are read once. Term counts, document frequencies and segments are written below the shared folder.
    """
    spark = docs.sparkSession
    at = staging_path(spark, "lexical")
    rows = columns_of(docs, id_col, text_col).withColumn(id_col, F.col(id_col).cast("long"))
    with batches_of(spark, 1_000):
        counted(rows, id_col, text_col, vocabulary).withColumnRenamed("id", "doc_id").write.parquet(f"{at}/counts")
    counts = spark.read.parquet(f"{at}/counts")
    total = counts.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/frequencies")
    held = counts.where(F.size("terms") > 0)
    with batches_of(spark, 1_000):
        held.mapInArrow(_segments(total["docs"], total["length"]), SEGMENT).write.parquet(f"{at}/segments")
    return Index(spark, at, total["docs"], total["length"])


# ---------------------------------------------------------------- search

class Best:
    """The k best documents of a query so far: greatest score first, equal scores by id, rows without an id last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """The score a further document must reach, which is at least 1."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, scores: np.ndarray, doc_ids: np.ndarray, no_id: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.least):
            entry = (int(scores[i]), not no_id[i], -int(doc_ids[i]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            else:
                heapq.heappushpop(self.heap, entry)


def search_segment(seg: Segment, query: list[tuple[str, int]], best: Best, seen: dict[str, int] | None = None) -> None:
    """Bring ``best`` up to date with a segment. ``seen`` counts blocks read and skipped and documents scored."""
    known = [(seg.place[t], w) for t, w in query if w > 0 and t in seg.place]
    if not known:
        return
    weight = np.zeros(len(seg.terms), np.int64)
    for t, w in known:
        weight[t] = w
    tops = {t: w * int(seg.block_max[seg.list_blocks[t]:seg.list_blocks[t + 1]].max()) for t, w in known}
    lists = sorted(tops, key=lambda t: (-tops[t], t))
    left, done = sum(tops.values()), np.zeros(len(seg.doc_ids), bool)
    for t in lists:
        if left < best.least:  # a document in the lists left alone cannot reach the score
            break
        left -= tops[t]
        first, last = int(seg.list_blocks[t]), int(seg.list_blocks[t + 1])
        if seg.sum_ptr[last] > seg.sum_ptr[first]:
            a, b = seg.sum_ptr[first], seg.sum_ptr[last]
            bounds = np.add.reduceat(weight[seg.sum_cols[a:b]] * seg.sum_max[a:b], seg.sum_ptr[first:last] - a)
            order = np.argsort(-bounds, kind="stable")
        else:
            bounds, order = None, [0]
        for o in order:
            if bounds is not None and bounds[o] < best.least:  # bounds fall from here on
                if seen is not None:
                    seen["skipped"] += len(order) - int(np.flatnonzero(order == o)[0])
                break
            members = seg.block_docs[seg.block_ptr[first + o]:seg.block_ptr[first + o + 1]]
            fresh = members[~done[members]]
            if seen is not None:
                seen["read"] += 1
                seen["scored"] += len(fresh)
            if len(fresh):
                done[fresh] = True
                at, starts = spans(seg.ptr[fresh], seg.ptr[fresh + 1])
                scores = np.add.reduceat(weight[seg.cols[at]] * seg.impacts[at], starts)
                best.add(scores, seg.doc_ids[fresh], seg.no_id[fresh])


HITS = "query_no int, doc_id long, score long"


def _search(asked, k: int):
    """Rows of segments to the k best documents of every query within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for packed in batch.column("segment"):
                seg = Segment.read(packed.as_buffer())
                for query, kept in zip(queries, best):
                    search_segment(seg, query, kept)
                del seg
                give_back()
        rows = [(q, -i if has else None, s) for q, kept in enumerate(best) for s, has, i in kept.heap]
        nos, ids, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(nos, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query_no", "doc_id", "score"])
    return run


def top(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each key with their rank; shares of a key are thinned out first, so no task holds all of them."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    few = hits.withColumn("_part", part).withColumn("_r", F.row_number().over(W.Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_r") <= k)
    return few.drop("_part", "_r").withColumn("rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, doc_id, score) of the k best documents of each row (query, terms), all with a score above 0.

    Weights come from the index's document frequencies. Queries pass over the index in blocks of ``QUERY_BLOCK``;
    each task keeps k documents a query, which are merged by a shuffle of those alone.
    """
    spark = index.spark
    kind = asked.schema["query"].dataType
    size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "terms"))), F.lit(0))).first()
    blocks = max(1, -(-size[0] // QUERY_BLOCK), -(-size[1] // QUERY_BYTES))
    weight = F.floor(1000 * F.log((2 * F.lit(index.docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = index.frequencies().select("term", weight.alias("weight"))
    found = []
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b).collect()
        lines = [(no, t) for no, r in enumerate(some) for t in r["terms"]]
        words = spark.createDataFrame(lines, "query_no int, term string").select("term").distinct()
        known = {r.term: int(r.weight) for r in weights.join(words, "term").collect()}
        asking = spark.sparkContext.broadcast([[(t, known[t]) for t in r["terms"] if known.get(t, 0) > 0] for r in some])
        with batches_of(spark, 1):
            hits = cut_lineage(index.segments().mapInArrow(_search(asking, k), HITS))
        names = spark.createDataFrame([(no, r["query"]) for no, r in enumerate(some)], T.StructType([T.StructField("query_no", T.IntegerType()), T.StructField("query", kind)]))
        found.append(top(hits, k, "query_no").join(names, "query_no").select("query", "rank", "doc_id", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k best documents of every query row: the query's id, rank (from 1), doc_id and score, greatest score first.

    Only documents that score above 0 count; equal scores go by ascending id, rows without an id come last. Ids of
    documents are whole numbers. Rows that repeat are documents, or queries, of their own. Null and empty texts have no
    terms: as documents they are not counted, as queries they find nothing. Other columns are not read; empty tables
    give an empty table.
    """
    asked = query_terms(queries, query_id, query_text)
    index = build_index(docs, _vocabulary(asked), id_col, text_col)
    return search(index, asked, k).withColumnRenamed("query", query_id)
