"""Similarity self-join on word n-grams: MinHash LSH forest, exact verification.

1. Texts with one set of shingles are one class of copies, found by one
   aggregation; all later steps see one representative ("node") of a class.
2. A node's MinHash signature gives TREES labels of DEPTH bytes, one 64-bit
   number each. In number order the labels of a tree are its sorted trie, and a
   shift to the right is the prefix that names a trie node; equal prefixes are
   grouped, which needs no global sort.
3. Prefixes are matched from the full label on and shortened until the recall
   is reached. It is measured: a pair of similarity s is found at a depth with a
   known probability p(s), so the links found there stand for the sum of 1 / p(s)
   links in all. ``shortest_prefix`` bounds the search: at that depth even pairs
   at the threshold are found with the target recall.
4. Every trie node of a depth yields all its pairs. Those of a small one are
   made one by one; a larger one (a crowd) is dealt into blocks, and each pair of
   blocks is one task's work: all intersections at once, as a matrix product. A
   pair that meets in several crowds counts in the first of them only.
5. Candidates are verified on their whole shingle sets. A pair of blocks hands on
   how many links each node has there and a spanning forest of them, so that a
   crowd's links are never moved. Links are closed to classes by alternating star
   contraction.

Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, documents_of, inverse_powers, join_heavy, mix64, prefix_sums, row_hash, sized_broadcast, small_batches, table, word_spans

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 16, 7
TARGET_RECALL = 0.99
#: Pairs of trie nodes of at most so many texts are made one by one.
SMALL = 16
#: Larger ones are dealt into blocks of about so many texts and shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Shingles that a matrix of a block holds at a time.
COLUMNS = 2048
_SEED = 20231
#: Bits of a label for each step down a trie.
STEP = 8


def shortest_prefix(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which all trees together reach the recall."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.int64).astype(np.uint64)
    b = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.int64).astype(np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text.

    Words are lower-cased runs between blanks. A text with fewer words than an
    n-gram has one shingle of all its words; one without words has none.
    """
    data = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    raw, start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    n = min(words, len(start))
    start, end = start[: len(start) - n + 1], end[n - 1 :]
    p = prefix_sums(raw.astype(np.uint64) + np.uint64(1))
    h = (p[end] - p[start]) * inverse_powers(len(p))[start]
    return np.unique(mix64(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def signature(hashes: np.ndarray) -> np.ndarray:
    a, b = _coefficients()
    out = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * a + b
        np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(axis=0), out=out)
    return out


def _set_hash(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def labels(sig: np.ndarray) -> np.ndarray:
    """A label for each tree: the low bytes of its DEPTH values, first one on top."""
    trees = sig.reshape(TREES, DEPTH).astype(np.uint64) & np.uint64((1 << STEP) - 1)
    shifts = np.arange(DEPTH - 1, -1, -1, dtype=np.uint64) * np.uint64(STEP)
    return (trees << shifts).sum(axis=1, dtype=np.uint64).astype(np.int64)


def chance(similarity, depth: int):
    """The probability that a pair shares a prefix of ``depth`` in some tree.

    Takes numbers, arrays and columns.
    """
    step = similarity + (1 - similarity) / 2**STEP
    return 1 - (1 - step**depth) ** TREES


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, own = [], [], []
            for text in b.column(2).to_pylist():
                h = shingles(text, words)
                nodes.append(_set_hash(h) if len(h) else None)
                sizes.append(len(h))
                own.append(labels(signature(h)) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(own, pa.list_(pa.int64()))], ["id", "row", "node", "size", "labels"])

    return run


def _sets(words: int):
    """Shingle sets of fetched texts, kept if they are the node's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [(n, h.tobytes()) for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if _set_hash(h := shingles(t, words)) == n]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([h for _, h in found], pa.binary())], ["node", "hashes"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    out.append(0.0)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / (len(p) + len(q) - both))
            keep = pa.array([j >= similarity for j in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], ["a", "b", "jaccard"]).filter(keep)

    return run


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of x shares with each of y."""

    def coded(sets: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        code = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        held = np.flatnonzero(known[code] == flat)
        held = held[np.argsort(code[held], kind="stable")]
        return row[held], code[held]

    out = np.zeros((len(x), len(y)), dtype=np.float32)
    known = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    if not len(known):
        return out
    sides = [coded(x, known), coded(y, known)]
    for at in range(0, len(known), COLUMNS):
        held = []
        for (row, code), sets in zip(sides, (x, y), strict=True):
            low, high = np.searchsorted(code, [at, at + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, len(known) - at)), dtype=np.float32)
            part[row[low:high], code[low:high] - at] = 1
            held.append(part)
        out += held[0] @ held[1].T
    return out


def _forest(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a bipartite graph a row of its component, or -1."""
    back = np.ascontiguousarray(keep.T)
    rows, columns = np.full(keep.shape[0], -1), np.full(keep.shape[1], -1)
    for start in np.flatnonzero(keep.any(axis=1)).tolist():
        if rows[start] >= 0:
            continue
        rows[start] = start
        front = np.array([start])
        while len(front):
            side = np.flatnonzero(keep[front].any(axis=0) & (columns < 0))
            columns[side] = start
            front = np.flatnonzero(back[side].any(axis=0) & (rows < 0))
            rows[front] = start
    return rows, columns


def _meet(similarity: float, depth: int, whole: bool):
    """Verifies all pairs of two blocks of a crowd, or of one with itself.

    Yields the pairs if ``whole``, else (node, other, n, w): a node's links here,
    a node of its component, and how many links those found stand for.
    """

    def run(cell: pa.Table) -> pa.Table:
        tree, i, j = (cell.column(c)[0].as_py() for c in ("tree", "i", "j"))
        own = cell.column("own").to_numpy()
        node, sets = cell.column("node").to_pylist(), [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in cell.column("hashes")]
        crowds = np.array(cell.column("crowds").to_pylist(), dtype=np.int64).reshape(len(own), TREES)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        keep = np.zeros((len(left), len(right)), dtype=bool)
        if len(left) and len(right):
            both = intersections([sets[k] for k in left], [sets[k] for k in right]).astype(np.float64)
            size = np.array([len(h) for h in sets], dtype=np.float64)
            jaccard = both / (size[left][:, None] + size[right][None, :] - both)
            keep = jaccard >= similarity
            for k in range(tree):
                p, q = crowds[left, k][:, None], crowds[right, k][None, :]
                keep &= (p != q) | (p == 0)
            if i == j:
                keep = np.triu(keep, 1)
        if whole:
            r, c = np.nonzero(keep)
            a, b = [node[k] for k in left[r]], [node[k] for k in right[c]]
            found = [(min(p), max(p)) for p in zip(a, b, strict=True)]
            return pa.table({"a": pa.array([p for p, _ in found], pa.binary()), "b": pa.array([q for _, q in found], pa.binary()), "jaccard": pa.array(jaccard[r, c] if len(r) else [], pa.float64())})
        if i == j:
            keep |= keep.T
        # A block with itself: a node's row and column are one, so that both find the
        # same component; without that a pair, a path or a star falls apart.
        rows, columns = _forest(keep | np.diag(keep.any(axis=1)) if i == j else keep)
        stand = np.where(keep, 1 / chance(jaccard, depth), 0.0) if keep.any() else np.zeros(keep.shape)
        if i == j:
            stand = np.maximum(stand, stand.T)
        ends = [(left, rows, keep.sum(axis=1), stand.sum(axis=1))] + ([] if i == j else [(right, columns, keep.sum(axis=0), stand.sum(axis=0))])
        out = [(node[at], node[left[root]], int(n), w) for side, roots, many, sums in ends for at, root, n, w in zip(side.tolist(), roots.tolist(), many.tolist(), sums.tolist(), strict=True) if n]
        kinds = {"node": pa.binary(), "other": pa.binary(), "n": pa.int64(), "w": pa.float64()}
        return pa.table({name: pa.array([row[k] for row in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    return run


def _key(depth: int) -> Column:
    """Names the trie node that a label belongs to at a depth."""
    return F.xxhash64("tree", F.shiftrightunsigned("label", STEP * (DEPTH - depth)))


def _colliding(nodes: DataFrame, depth: int) -> DataFrame:
    """node, size, tree, label: the labels that share a prefix with another's.

    Taken at the shortest prefix, these are all that can meet at longer ones;
    nearly all labels end here, so every depth is looked at in few rows.
    """
    rows = nodes.select("node", "size", F.posexplode("labels").alias("tree", "label")).withColumn("key", _key(depth))
    groups = checkpoint(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return checkpoint(join_heavy(rows, groups, "key", "n").select("node", "size", "tree", "label"))


def _candidates(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs (a < b) of small trie nodes, rows of crowds) at a depth.

    Rows of crowds are key, node, tree and the number of blocks of the crowd.
    """
    rows = rows.withColumn("key", _key(depth))
    groups = checkpoint(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1"))
    rows = checkpoint(join_heavy(rows, groups, "key", "n"))
    few = rows.where(f"n <= {SMALL}").groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    return few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), rows.where(f"n > {SMALL}").select("key", "node", "tree", blocks.alias("blocks"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node.

    Alternating large-star and small-star contraction, until nothing changes.
    Each round's edges are checkpointed. A node with very many neighbours takes
    its minimum from partial ones, and gives it back as a heavy key.
    """

    def spread(edges: DataFrame, of: str, least: DataFrame) -> DataFrame:
        return join_heavy(edges, checkpoint(least), of, "n")

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        return spread(both.where("v > u"), "u", least).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()

    def small(e: DataFrame) -> DataFrame:
        moved = spread(e, "b", e.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")))
        return moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(moved.select(F.col("m").alias("a"), F.col("b"))).where("a < b").distinct()

    edges = checkpoint(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, now = None, mark(edges)
    while now != before:
        edges = checkpoint(small(checkpoint(large(edges))))
        before, now = now, mark(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    ``members`` has one row per input row: id, row (a hash of the text), node,
    class_id, class_row, copies, n_links. ``class_id`` and ``class_row`` are
    those of the class's least row by (id, row), ``copies`` the number of rows
    with the same shingle set, ``n_links`` the number of other nodes that the
    node is linked to. ``links`` holds the verified pairs: a, b, jaccard (of
    nodes); those of crowds are worked out only when it is read.

    Texts without words (null and empty ones) have no node, link to nothing and
    are each their own class. Rows that repeat an id are told apart by ``row``;
    rows that repeat id and text are copies. Rows with a null id take part and
    count as the last ones; ``class_id`` is null only if all ids of the class
    are. Empty table: no rows. Other columns are ignored.
    """
    docs = documents_of(df, id_col, text_col, row_hash(text_col).alias("row")).select("id", "row", "text")
    least = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("row", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("labels", T.ArrayType(T.LongType()))])
    signed = checkpoint(docs.mapInArrow(_sign(words), kind))
    full = signed.where("node IS NOT NULL")
    nodes = checkpoint(full.groupBy("node").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("size"), F.any_value("labels").alias("labels")))

    def fetched(ends: DataFrame) -> DataFrame:
        """The shingle sets of nodes, made anew from one text of each."""
        wanted = checkpoint(nodes.select("node", F.col("least").alias("want")).join(ends, "node"))
        small = sized_broadcast(wanted)
        texts = docs.join(small, docs["id"].eqNullSafe(small["want.id"]) & (docs["row"] == small["want.row"])).select("node", "text")
        return checkpoint(texts.mapInArrow(_sets(words), "node binary, hashes binary").dropDuplicates(["node"]))

    sets: DataFrame | None = None
    tried: DataFrame | None = None
    few: DataFrame | None = None
    shortest = shortest_prefix(similarity, recall)
    meeting = _colliding(nodes.select("node", "size", "labels"), shortest)
    for depth in range(DEPTH, shortest - 1, -1):
        pairs, crowds = map(checkpoint, _candidates(meeting, depth))
        # A node's crowds by tree; 0 where its trie node is small.
        in_crowds = crowds.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("of"))
        in_crowds = checkpoint(in_crowds.select("node", F.array(*[F.coalesce(F.try_element_at("of", F.lit(k)), F.lit(0)) for k in range(TREES)]).alias("crowds")))
        # Pairs that longer prefixes have matched are verified already.
        fresh = pairs if tried is None else checkpoint(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs
        ends = fresh.select(F.col("a").alias("node")).union(fresh.select(F.col("b").alias("node"))).union(in_crowds.select("node")).distinct()
        # Prefixes that are shortened match all that they matched before.
        sets = fetched(ends) if sets is None else sets.unionByName(fetched(ends.join(sets.select("node"), "node", "left_anti")))
        crowd_of = sized_broadcast(in_crowds)
        known_sets = sets.join(crowd_of, "node", "left")
        left, right = known_sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"), F.col("crowds").alias("p")), known_sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"), F.col("crowds").alias("q"))
        # A pair that meets in a crowd as well is left to the crowd.
        crowded = F.exists(F.arrays_zip("p", "q"), lambda z: (z["p"] == z["q"]) & (z["p"] != 0))
        alone = ~F.coalesce(crowded, F.lit(False))
        apart = fresh.join(right, "b").join(left, "a").where(alone)
        found = apart.select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a binary, b binary, jaccard double")
        if few is not None:
            p, q = (crowd_of.select(F.col("node").alias(end), F.col("crowds").alias(name)) for end, name in (("a", "p"), ("b", "q")))
            found = found.unionByName(few.join(p, "a", "left").join(q, "b", "left").where(alone).select("a", "b", "jaccard"))
        few = checkpoint(found)
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        cells = crowds.join(known_sets.where("crowds IS NOT NULL"), "node").select("key", "tree", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"), "node", "hashes", "crowds")
        cells = cells.select("key", "tree", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "hashes", "crowds").groupBy("key", "i", "j")
        met = cells.applyInArrow(_meet(similarity, depth, False), "node binary, other binary, n long, w double")
        one, stand = F.lit(1).cast("long"), 1 / chance(F.col("jaccard"), depth)
        ties = checkpoint(met.union(few.select("a", "b", one, stand)).union(few.select("b", "b", one, stand)))
        links = few.union(cells.applyInArrow(_meet(similarity, depth, True), "a binary, b binary, jaccard double"))
        seen = ties.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
        # Half of what the target allows to be lost is left to the measure's error.
        if seen["n"] and seen["n"] / seen["w"] >= (1 + recall) / 2:
            break

    degree = ties.groupBy("node").agg(F.sum("n").alias("n_links"))
    roots = connected_components(ties.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = checkpoint(nodes.select("node", "least").join(roots, "node"))
    first = checkpoint(linked.groupBy("root").agg(F.min("least").alias("class"), F.count(F.lit(1)).alias("n")))
    classes = join_heavy(linked.select("node", "root"), first, "root", "n").join(degree, "node").select("node", "class", "n_links")
    known = nodes.select("node", "least", "copies").join(classes, "node", "left").select("node", F.coalesce("class", "least").alias("class"), "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # A node of very many copies is met by a broadcast of the heavy nodes.
    members = join_heavy(full.select("id", "row", "node"), checkpoint(known), "node", "copies")
    members = members.select("id", "row", "node", F.col("class.id").alias("class_id"), F.col("class.row").alias("class_row"), "copies", "n_links")
    bare = signed.where("node IS NULL").select("id", "row", "node", F.col("id").alias("class_id"), F.col("row").alias("class_row"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"))
    return members.unionByName(bare).withColumnRenamed("id", id_col), links


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    members, _ = jaccard_join(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "class_id", "copies", "n_links")


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES: dict[str, str] = {}
