"""Similarity join of word shingle sets: signature trees inside prefix groups, then inside clusters, exact at the leaves.

1. Texts with one shingle set form a class; every later step sees a class once, however many copies it has.
2. Two sets can only reach the similarity if their prefixes share a shingle (rare shingles first). Classes that share
   one meet in that shingle's group; groups of the same classes are one. A signature tree over the group - nodes with
   OR-ed bitmaps, size and bit ranges - is traversed against itself; node pairs whose greatest possible overlap is too
   small are pruned, as are pairs that are joined already. What is left connects classes to clusters, a superset of the
   true components. A large group is cut into blocks; what its greatest part leaves out meets every block.
3. Each cluster's texts are gathered once, in blocks of bounded size, and a tree with sharper bitmaps decides which sets
   are compared exactly. Pairs already in one component are pruned, so copies by the thousand cost a chain of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import columns_of, components, give_back, release, small, worker_cache
from .wordhash import per_text, shingles

SIZE = 3          # words of a shingle
PERCENT = 90      # intersection over union
HEAVY = 1000      # a shingle in more than one of so many texts is ordered last
GROUP = 1024      # classes of a prefix group that are traversed together
CLUSTER = 1500    # classes of a cluster that are compared in one task
ANCHORS = 24      # classes of a large group or cluster that every block sees
HELD = 1 << 21    # shingles that a task holds before it counts them


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    worker_cache("ngramjoin")
    for h in per_text(column):
        yield np.unique(shingles(h, size))


# ---------------------------------------------------------------- order of shingles and signatures

def _frequent(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs = total = 0

        def out() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = n >= max(2, docs / (2 * HEAVY))
            names = np.concatenate([t[keep].view(np.int64), [0]])
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([n[keep], [docs]]).astype(np.int64)), pa.array(np.arange(len(names)) == len(names) - 1)], ["token", "n", "texts"])
        for batch in batches:
            for s in _sets(batch.column(0), size):
                held.append(s)
                docs += len(s) > 0
                total += len(s)
                if total >= HELD:
                    yield out()
                    held.clear()
                    docs = total = 0
        yield out()
    return run


def heavy_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles of more than one text in ``HEAVY``, rarest first; at most ``HEAVY`` times the mean set size of them.

    Tasks report what is frequent among their own texts, so a count can be a little low. The order only has to be the
    same everywhere; it decides which shingles make groups, never which pairs are found.
    """
    seen = cut_lineage(texts.mapInArrow(_frequent(size), "token long, n long, texts boolean").groupBy("texts", "token").agg(F.sum("n").alias("n")))
    docs = seen.where("texts").agg(F.sum("n")).first()[0] or 0
    rows = seen.where(~F.col("texts") & (F.col("n") * HEAVY > docs) & (F.col("n") >= 8)).select("token", "n").collect()
    return np.array([t for _, t in sorted((r.n, r.token) for r in rows)], np.int64).view(np.uint64)


def bits_for(n: int) -> int:
    """Bits of a signature, one or two for each shingle: with fewer, unrelated sets of almost twice as many shingles pass at 80 percent."""
    return 1 << min(max(int(n).bit_length(), 7), 16)


def bitmap(s: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(bits, bool)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def prefix_size(n: int, percent: int) -> int:
    """So many of the first shingles of a set of ``n`` must hold one of any set that is similar enough."""
    return n - -(-percent * n // 100) + 1


def _signatures(size: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = heavy.value
        by_token = np.argsort(order)
        ranked = order[by_token]
        met: set[int] = set()
        for batch in batches:
            ids, ns, classes, prefixes, maps = batch.column(0), [], [], [], []
            for s in _sets(batch.column(1), size):
                n = len(s)
                ns.append(n)
                if not n:
                    classes.append(None)
                    prefixes.append(None)
                    maps.append(None)
                    continue
                c = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                classes.append(c)
                if c in met:  # a copy: its class is known from this task already
                    prefixes.append(None)
                    maps.append(None)
                    continue
                if len(met) < 1_000_000:
                    met.add(c)
                k = prefix_size(n, percent)
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, s), len(ranked) - 1)
                    common = ranked[at] == s
                    first = s[~common][:k]
                    if len(first) < k:
                        rank = by_token[at[common]]
                        first = np.concatenate([first, s[common][np.argsort(rank)][:k - len(first)]])
                else:
                    first = s[:k]
                prefixes.append(first.view(np.int64))
                maps.append(bitmap(s, bits_for(n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary()), batch.column(2)],
                                             ["doc_id", "n", "class", "prefix", "bits", "mark"])
    return run


# ---------------------------------------------------------------- signature trees

def fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits >>= 1
        x = (x >> bits) | (x & ((1 << bits) - 1))
    return x


class Node:
    """Leaves from ``first`` to ``end``: OR of their bitmaps at the coarsest resolution, ranges of sizes and set bits."""

    __slots__ = ("first", "end", "bits", "map", "least", "most", "set_bits", "left", "right", "one")

    def __init__(self, first, end, bits, map_, least, most, set_bits, left=None, right=None):
        self.first, self.end, self.bits, self.map, self.least, self.most, self.set_bits, self.left, self.right = first, end, bits, map_, least, most, set_bits, left, right
        self.one = left is None  # whether all its leaves are known to be joined


class SignatureTree:
    """Leaves ordered by set size under binary nodes; ``join`` walks pairs of nodes and yields pairs of leaves."""

    def __init__(self, sizes: list[int], maps: list[int], bits: list[int], percent: int):
        self.sizes, self.maps, self.bits, self.percent = sizes, maps, bits, percent
        self.parent = list(range(len(sizes)))
        level = [Node(i, i + 1, b, m, n, n, m.bit_count()) for i, (n, m, b) in enumerate(zip(sizes, maps, bits))]
        while len(level) > 1:
            level = [self._over(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        self.root = level[0]

    def _over(self, a: Node, b: Node) -> Node:
        bits = min(a.bits, b.bits)
        if a.bits == b.bits:
            fewest = min(a.set_bits, b.set_bits)
        else:
            fewest = min(fold(self.maps[i], self.bits[i], bits).bit_count() for i in range(a.first, b.end))
        return Node(a.first, b.end, bits, fold(a.map, a.bits, bits) | fold(b.map, b.bits, bits), a.least, b.most, fewest, a, b)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def possible(self, a: Node, b: Node) -> bool:
        """Whether sizes and bitmaps leave room for the overlap that the similarity needs."""
        if 100 * a.most < self.percent * b.least or 100 * b.most < self.percent * a.least:
            return False
        if a.bits == b.bits:
            common = (a.map & b.map).bit_count()
            room = min(a.most - max(a.set_bits - common, 0), b.most - max(b.set_bits - common, 0))
        elif a.bits > b.bits:
            room = min(a.most, b.most - max(b.set_bits - (fold(a.map, a.bits, b.bits) & b.map).bit_count(), 0))
        else:
            room = min(b.most, a.most - max(a.set_bits - (fold(b.map, b.bits, a.bits) & a.map).bit_count(), 0))
        return (100 + self.percent) * room >= self.percent * (a.least + b.least)

    def _joined(self, a: Node) -> bool:
        """Whether all leaves of a node are in one component."""
        if not a.one:
            a.one = self._joined(a.left) and self._joined(a.right) and self.find(a.left.first) == self.find(a.right.first)
        return a.one

    def join(self) -> Iterator[tuple[int, int]]:
        """Pairs of leaves that may be similar and are not joined yet; the caller unites those that are.

        Neighbours in size come first, so a chain of copies joins before wider pairs are looked at.
        """
        todo = [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            if a is b:
                if a.left is not None and not self._joined(a):
                    todo += [(a.left, a.right), (a.right, a.right), (a.left, a.left)]
                continue
            if self.find(a.first) == self.find(b.first) and self._joined(a) and self._joined(b):
                continue
            if not self.possible(a, b):
                continue
            if a.left is None and b.left is None:
                yield a.first, b.first
            elif b.left is None or (a.left is not None and a.end - a.first >= b.end - b.first):
                todo += [(a.left, b), (a.right, b)]
            else:
                todo += [(a, b.right), (a, b.left)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of ordered batches by their first ``keys`` columns."""
    now, held = None, None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        if not batch.num_rows:
            continue
        names = list(zip(*cols[:keys]))
        begin = 0
        while begin < len(names):
            end = begin + 1
            key = names[begin]
            while end < len(names) and names[end] == key:
                end += 1
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, [[] for _ in cols[keys:]]
            for h, c in zip(held, cols[keys:]):
                h.extend(c[begin:end])
            begin = end
    if now is not None:
        yield now, held


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _unite_parts(tree: SignatureTree, parts: list) -> None:
    """Leaves of one part were joined in an earlier round."""
    first: dict[int, int] = {}
    for i, part in enumerate(parts):
        if part is not None:
            tree.unite(first.setdefault(part, i), i)


def _candidates(percent: int):
    """Edges that connect the classes of a prefix group that may be similar: at most one fewer than there are classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for _, (classes, sizes, maps, parts) in _groups(batches, 2):
            own = {c: (n, c, m, p) for c, n, m, p in zip(classes, sizes, maps, parts)}
            rows = sorted(own.values(), key=lambda r: r[:2])
            if len(rows) < 2:
                continue
            tree = SignatureTree([r[0] for r in rows], [int.from_bytes(r[2], "little") for r in rows], [8 * len(r[2]) for r in rows], percent)
            _unite_parts(tree, [r[3] for r in rows])
            for i, j in tree.join():
                if tree.unite(i, j):
                    found.add((rows[i][1], rows[j][1]))
            if len(found) > 200_000:
                yield _pairs(list(found))
                found.clear()
        yield _pairs(list(found))
    return run


def _blocks_of_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[int, tuple[np.ndarray, int]]]:
    """{class: (its set, part)} of each (cluster, block) of ordered rows; a text is dropped as soon as its set is made."""
    now, wanted = None, {}
    for batch in batches:
        names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        rows = zip(names, batch.column(2).to_pylist(), batch.column(3).to_pylist(), _sets(batch.column(4), size))
        for key, c, part, s in rows:
            if key != now:
                if wanted:
                    yield wanted
                now, wanted = key, {}
            if c not in wanted and len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == c:
                wanted[c] = (s, part)
    if wanted:
        yield wanted


def _verified(size: int, percent: int):
    """Links of a block: exact intersections of the sets that the tree lets through, until the block's components stand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wanted in _blocks_of_sets(batches, size):
            rows = sorted(wanted, key=lambda c: (len(wanted[c][0]), c))
            if len(rows) < 2:
                continue
            sets = [wanted[c][0] for c in rows]
            bits = [min(2 * bits_for(len(s)), 1 << 17) for s in sets]
            tree = SignatureTree([len(s) for s in sets], [int.from_bytes(bitmap(s, b), "little") for s, b in zip(sets, bits)], bits, percent)
            _unite_parts(tree, [wanted[c][1] for c in rows])
            found = []
            for i, j in tree.join():
                if tree.find(i) == tree.find(j):
                    continue
                a, b = sets[i], sets[j]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    tree.unite(i, j)
                    found.append((rows[i], rows[j]))
            del sets, bits, tree
            wanted.clear()
            yield _pairs(found)
        give_back()
    return run


# ---------------------------------------------------------------- the join

def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Members (class, doc_id and more) with their texts; only these texts are moved."""
    want = small(members)
    return docs.join(want.withColumnRenamed("doc_id", "_rep"), docs["doc_id"].eqNullSafe(F.col("_rep"))).drop("_rep", "doc_id")


def _check(docs: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside (cluster, block) groups of classes; ``dealt`` has cluster, block, class, part, doc_id."""
    rows = _texts_of(docs, dealt).select("cluster", "block", "class", "part", "text")
    rows = rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    return rows.mapInArrow(_verified(size, percent), "a long, b long")


def _meet(signs: DataFrame, dealt: DataFrame, percent: int) -> DataFrame:
    """Edges inside (token, block) groups of classes; ``dealt`` has token, block, class, part, ``signs`` class, n, bits."""
    rows = dealt.join(signs, "class").select("token", "block", "class", "n", "bits", "part")
    rows = rows.repartition("token", "block").sortWithinPartitions("token", "block")
    return rows.mapInArrow(_candidates(percent), "a long, b long")


def _anchored(own: DataFrame, key: str) -> DataFrame:
    """Members (key, blocks, block, class and more) without ``blocks``, some of each large group in every block of it, so that what is linked joins."""
    rest = [c for c in own.columns if c not in (key, "blocks", "block")]
    some = own.where("blocks > 1").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("class", F.lit(5))))).where(F.col("_r") <= ANCHORS)
    spread = some.select(key, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), *rest)
    return own.drop("blocks").select(key, "block", *rest).union(spread).distinct()


def _outside(own: DataFrame, links: DataFrame, key: str, per: int) -> DataFrame | None:
    """What the links of a large group's blocks leave outside its greatest part meets everything, block by block: members with part, or none."""
    rest = [c for c in own.columns if c not in (key, "blocks", "block", "class")]
    parts = components(links)
    placed = own.where("blocks > 1").join(parts, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("root", "class")).drop("node", "root")
    placed = cut_lineage(placed)
    sizes = placed.groupBy(key, "part").agg(F.count("*").alias("_p"))
    top = sizes.groupBy(key).agg(F.max(F.struct("_p", "part")).alias("_t")).select(key, F.col("_t.part").alias("_top"))
    minor = placed.join(top, key).where("part <> _top")
    slices = minor.groupBy(key).agg(F.expr(f"cast((count(*) + {per - 1}) div {per} as int)").alias("slices"))
    if slices.isEmpty():
        return None
    minor = minor.join(slices, key).withColumn("slice", F.pmod(F.xxhash64("class", F.lit(9)), F.col("slices")))
    left = minor.select(key, F.explode(F.expr("sequence(0, blocks - 1)")).alias("_j"), F.col("slice").alias("_i"), "class", "part", *rest)
    right = placed.join(slices, key).select(key, F.col("block").alias("_j"), F.explode(F.expr("sequence(0, slices - 1)")).alias("_i"), "class", "part", *rest)
    return left.union(right).select(key, (F.col("_j").cast("long") * (1 << 31) + F.col("_i")).alias("block"), "class", "part", *rest).distinct()


def similar_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs without white space, A-Z lower-cased. A text's set has its distinct shingles of ``size`` words; with
    fewer words the whole sequence is one; null, empty and blank texts have none and link with nothing. Two texts link
    when 100 * intersection >= ``percent`` * union. ``component_id`` is the least id reachable by links, the own included.

    Rows that repeat an id are texts of their own; ids that are null never name a component (it is null if there is no
    other id). Sets are compared by 64-bit hashes. Other input columns are not returned; an empty table gives an empty table.
    """
    return _labelled(docs, size, percent, id_col, text_col, group, cluster).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, group: int = GROUP, cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, mark, n_shingles, root, component_id) for every row: a hash of its text and the class that names its component."""
    docs = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    heavy = context.broadcast(heavy_shingles(docs.select("text"), size))
    signed = cut_lineage(docs.withColumn("mark", F.xxhash64("text")).mapInArrow(_signatures(size, percent, heavy), "doc_id long, n long, class long, prefix array<long>, bits binary, mark long"))

    shared = signed.where("prefix is not null").select("class", "n", F.explode("prefix").alias("token"))
    by_token = Window.partitionBy("token").orderBy("n", "class")
    near = shared.select("token", "class", "n", F.lag(F.struct("class", "n")).over(by_token).alias("_b"), F.lead(F.struct("class", "n")).over(by_token).alias("_a"), F.dense_rank().over(by_token).alias("_r"))
    # a class has one rank, however many tasks emit it, so blocks are of distinct classes
    # in order of size: if neither neighbour is near enough in size, no class of the group is
    fits = (F.col("_b.class") != F.col("class")) & (100 * F.col("_b.n") >= percent * F.col("n")) | (F.col("_a.class") != F.col("class")) & (100 * F.col("n") >= percent * F.col("_a.n"))
    near = near.where(F.coalesce(fits, F.lit(False))).withColumn("block", F.expr(f"cast((_r - 1) div {group} as int)"))
    near = near.withColumn("blocks", F.max("block").over(Window.partitionBy("token")) + 1)
    groups = near.groupBy("token", "block", "blocks").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    # copies share many shingles, so most groups have the classes of another
    wide = F.col("blocks") > 1
    groups = groups.groupBy(F.when(wide, F.col("token")).alias("_t"), F.when(wide, F.col("block")).alias("_b"), "classes").agg(*[F.min(c).alias(c) for c in ("token", "block", "blocks")])
    groups = cut_lineage(groups.select("token", "block", "blocks", "classes"))
    classes = signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    classes = cut_lineage(classes)
    del shared, near
    release(docs.sparkSession)
    signs, none = classes.select("class", "n", "bits"), F.lit(None).cast("long").alias("part")
    own = groups.select("token", "blocks", "block", F.explode("classes").alias("class"))
    if own.where("blocks > 1").isEmpty():
        edges = _meet(signs, own.select("token", "block", "class", none), percent)
    else:
        edges = cut_lineage(_meet(signs, _anchored(own, "token").select("token", "block", "class", none), percent))
        both = _outside(own, edges, "token", group)
        if both is not None:
            edges = edges.union(_meet(signs, both, percent))
    clusters = components(edges).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    members = cut_lineage(clusters.join(classes.select("class", "doc_id"), "class"))
    del groups, own, edges, clusters
    release(docs.sparkSession)

    counted = members.groupBy("cluster").agg(F.count("*").alias("_n")).where("_n > 1")
    members = cut_lineage(members.join(counted, "cluster").withColumn("blocks", F.expr(f"cast((_n + {cluster - 1}) div {cluster} as int)")))
    own = members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    own = own.select("cluster", "blocks", "block", "class", "doc_id")
    links = cut_lineage(_check(docs, _anchored(own, "cluster").withColumn("part", none), size, percent))
    release(docs.sparkSession)
    if not own.where("blocks > 1").isEmpty():
        both = _outside(own, links, "cluster", cluster)
        if both is not None:
            links = cut_lineage(links.union(_check(docs, both, size, percent)))

    root = components(links).select(F.col("node").alias("class"), "root")
    named = classes.select("class", "doc_id").join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = cut_lineage(named.join(least, "root").select("class", "root", "component_id"))
    out = signed.select("doc_id", "mark", F.col("n").alias("n_shingles"), "class").join(small(labels), "class", "left")
    return out.select("doc_id", "mark", "n_shingles", "root", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_similar(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the least id; columns stay as they are.

    Rows without an id come after all others; of rows of one id the one with the least hash of its text stays, of equal
    rows one. Texts without words stay.
    """
    found = cut_lineage(_labelled(docs, size, percent, id_col, text_col).where("root is not null").select("doc_id", "mark", "root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("w"))
    first = cut_lineage(first.select(F.col("w.doc_id").alias("_drop_similar_id"), F.col("w.mark").alias("_drop_similar_mark")))
    key = ["_drop_similar_id", "_drop_similar_mark"]
    same = found.join(small(first), F.col("doc_id").eqNullSafe(F.col(key[0])) & (F.col("mark") == F.col(key[1])))
    kept = cut_lineage(same.groupBy(*key).agg(F.count("*").alias("_drop_similar_n")))
    have = {c.lower(): c for c in docs.columns}
    ident, text = F.col(f"`{have[id_col.lower()]}`"), F.col(f"`{have[text_col.lower()]}`")
    blank = ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    met = ident.cast("long").eqNullSafe(F.col(key[0])) & (F.xxhash64(text.cast("string")) == F.col(key[1]))
    joined = docs.join(small(kept), met, "left").where(F.col("_drop_similar_n").isNotNull() | blank)
    once = joined.where("_drop_similar_n is null or _drop_similar_n = 1").drop(*key, "_drop_similar_n")
    repeated = joined.where("_drop_similar_n > 1").withColumn("_drop_similar_r", F.row_number().over(Window.partitionBy(*key).orderBy(text)))
    return once.unionByName(repeated.where("_drop_similar_r = 1").drop(*key, "_drop_similar_n", "_drop_similar_r"))
