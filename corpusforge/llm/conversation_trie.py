"""Conversation prefix trie by chained digests.

1. Turns are sorted by range, so a long conversation spans several tasks, and
   texts are replaced by digests there; no text goes further.
2. A conversation is cut into blocks of BLOCK turns. In a block each prefix has
   the digest of the prefix before it and of its last turn; the digests of whole
   blocks are chained likewise, and the chain before a block is put in front of
   its digests. Equal prefixes, and only they, have equal digests.
3. Every prefix is exploded and grouped by (depth, digest): the nodes.
4. Every node is exploded to all its ancestors for the sums of subtrees. Within
   its block it goes to each of them; beyond, the sums of a block go to the first
   nodes of the blocks above, and from there to the ancestors of their parents.
   So a conversation of n turns makes n * BLOCK / 2 + (n / BLOCK)**2 / 2 rows in
   place of n * n / 2, and one of at most BLOCK turns exactly the latter.

A task holds a block, never a conversation or a group of copies. The members that
end at a node are listed by ranges, and the lists are read in order for their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_heavy, sized_broadcast, small_batches, table, text_of

#: Turns of a block.
BLOCK = 32
#: Ids that are listed in a row.
LISTED = 4096
#: Bytes of a digest: two of them are equal by chance once in 2**64 prefixes.
SIZE = 16


def _hash(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:SIZE]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, part, at, digest, chars of sorted turns; ``at`` counts within the task."""
    part, conv, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("conv").to_numpy()
        new = np.flatnonzero(np.concatenate([[conv is None or ids[0] != conv], ids[1:] != ids[:-1]]))
        number = np.arange(1, len(ids) + 1) + at
        for k, start in enumerate(new):
            end = new[k + 1] if k + 1 < len(new) else len(ids)
            number[start:end] = np.arange(1, end - start + 1)
        conv, at = ids[-1], int(number[-1])
        digests = []
        for role, text in zip(b.column("role"), b.column("text"), strict=True):
            r, t = role.as_buffer(), text.as_buffer()
            h = hashlib.sha256(r.size.to_bytes(8, "big"))
            h.update(r)
            h.update(t)
            digests.append(h.digest()[:SIZE])
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(np.full(len(ids), part, np.int32)), pa.array(number, pa.int64()), pa.array(digests, pa.binary()), pc.utf8_length(b.column("text")).cast(pa.int64())], ["conv", "part", "at", "digest", "chars"])


def turn_digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conv, pos, digest, chars of every turn; conv, n.

    ``pos`` counts the turns of a conversation from 1, by turn (null first), then
    role, then text. Null roles and texts are empty. Rows without a conversation
    id are left out. Other columns are ignored.
    """
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = checkpoint(dealt.mapInArrow(_digests, "conv long, part int, at long, digest binary, chars long"))
    # Where a conversation spans several tasks, what the ones before held comes on top.
    runs = checkpoint(turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = checkpoint(runs.select("conv", "part", before.alias("before")).where("before > 0"))
    placed = turns.join(sized_broadcast(later), ["conv", "part"], "left")
    return placed.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "chars"), checkpoint(runs.groupBy("conv").agg(F.sum("n").alias("n")))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, block, digests, chars of sorted turns: a row for each block."""
    conv = block = None
    digests: list[bytes] = []
    chars: list[int] = []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "block", "digests", "chars"])

    for b in batches:
        for c, k, d, n in zip(*(b.column(x).to_pylist() for x in ("conv", "block", "digest", "chars")), strict=True):
            if (c, k) != (conv, block):
                if digests:
                    out.append((conv, block, digests, chars))
                conv, block, digests, chars = c, k, [], []
            digests.append(_hash(digests[-1] if digests else b"", d))
            chars.append(n)
        if out:
            yield batch()
    if digests:
        out.append((conv, block, digests, chars))
        yield batch()


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the block behind each whole one: the chain so far, and its last prefix."""
    conv, chain = None, b""
    for b in batches:
        chains, befores = [], []
        for c, d in zip(b.column("conv").to_pylist(), b.column("digest").to_pylist(), strict=True):
            chain = chain if c == conv else b""
            conv = c
            befores.append(chain + d)
            chain = _hash(chain, d)
            chains.append(chain)
        yield pa.RecordBatch.from_arrays([b.column("conv"), pc.add(b.column("block"), 1), pa.array(chains, pa.binary()), pa.array(befores, pa.binary())], ["conv", "block", "chain", "before"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, part, at, ids: the decimal ids of (key, conv) rows sorted by both, some
    LISTED of them joined."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        out: list[tuple] = []
        key, ids = None, []
        for k, c in [*zip(b.column("key").to_pylist(), b.column("conv").to_pylist(), strict=True), (None, None)]:
            if ids and (k != key or len(ids) == LISTED):
                out.append((key, part, at, ",".join(ids)))
                at, ids = at + 1, []
            key = k
            ids.append(str(c))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["key", "part", "at", "ids"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 of listed ids sorted by key, part and at."""
    key = h = None
    for b in batches:
        out: list[tuple] = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(f",{ids}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["key", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends_sha256"])


def prefix_paths(turns: DataFrame) -> DataFrame:
    """conv, block, before, keys, chars: the keys of all prefixes, by blocks.

    ``before`` is the key of the prefix that the block's first one goes on from;
    that of the empty prefix is empty.
    """
    dealt = turns.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")
    blocks = checkpoint(dealt.select("conv", "block", "digest", "chars").mapInArrow(_chain, "conv long, block long, digests array<binary>, chars array<long>"))
    whole = blocks.where(F.size("digests") == BLOCK).select("conv", "block", F.element_at("digests", -1).alias("digest"))
    chains = whole.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_outer, "conv long, block long, chain binary, before binary")
    none = F.lit(b"")
    first = blocks.where("block = 0").select("conv", "block", none.alias("before"), F.col("digests").alias("keys"), "chars")
    later = blocks.where("block > 0").join(chains, ["conv", "block"]).select("conv", "block", "before", F.transform("digests", lambda d: F.concat("chain", d)).alias("keys"), "chars")
    return checkpoint(first.unionByName(later))


def _sums(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens: sums over the subtree of every node."""
    ways = paths.select("conv", "block", "keys")
    index = (F.col("depth") - 1) % BLOCK
    own = nodes.select("conv", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), (index + 1).cast("int").alias("upto"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    reached = checkpoint(own.join(ways, ["conv", "block"]).select("conv", "block", F.slice("keys", F.lit(1), F.col("upto")).alias("keys"), "leaves", "saved"))
    up = reached.select(F.explode("keys").alias("key"), "leaves", "saved")
    deep = reached.where("block > 0")
    if not deep.isEmpty():
        total = (F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # Of the nodes below the first one of a block its own has the least member.
        tops = deep.groupBy(F.col("keys")[0].alias("top")).agg(F.min("conv").alias("conv"), F.any_value("block").alias("block"), *total)
        above = tops.select("conv", F.explode(F.sequence(F.lit(1), F.col("block"))).alias("block"), "leaves", "saved").join(ways, ["conv", "block"])
        whole = checkpoint(above.groupBy(F.col("keys")[0].alias("top")).agg(F.min("conv").alias("conv"), F.any_value("block").alias("block"), *total))
        beyond = whole.select("conv", (F.col("block") - 1).alias("block"), "leaves", "saved").join(ways, ["conv", "block"])
        up = up.unionByName(beyond.select(F.explode("keys").alias("key"), "leaves", "saved"))
    return up.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every distinct prefix of conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv, pos (1, 2, ... without gaps), digest and chars;
    ``convs`` has every conv once, those without turns too. A node is named by its
    least member and its depth; the root is the empty prefix, with all as members.
    ``saved_tokens`` sums, over the subtree, the characters of the last turn for
    every member but one; ``ends_sha256`` is the digest of the ids of the members
    that end there, ascending and joined by commas.

    Repeated conversations are members of the same nodes. Without conversations
    there are no rows.
    """
    none = F.lit(b"")
    paths = prefix_paths(turns)
    prefixes = paths.select("conv", "before", "keys", "chars", F.explode(F.sequence(F.lit(1), F.size("keys"))).alias("i"), "block")
    i = F.col("i")
    each = prefixes.select("conv", (F.col("block") * BLOCK + i).alias("depth"), F.col("keys")[i - 1].alias("key"), F.col("chars")[i - 1].alias("chars"), F.when(i == 1, F.col("before")).otherwise(F.get("keys", i - 2)).alias("parent"))
    found = checkpoint(each.groupBy("depth", "key").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.any_value("chars").alias("chars"), F.any_value("parent").alias("parent")))
    kids = checkpoint(found.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")))
    nodes = checkpoint(found.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    sums = _sums(nodes, paths)

    last = paths.groupBy("conv").agg(F.max(F.struct("block", F.element_at("keys", -1).alias("key")))["key"].alias("key"))
    ended = convs.select("conv").join(last, "conv", "left").select(F.coalesce("key", none).alias("key"), "conv")
    # Members of a crowd of copies are sorted and listed by many tasks; only their
    # digest is taken in one go, list by list.
    lists = ended.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_listed, "key binary, part int, at long, ids string")
    ends = checkpoint(lists.repartition("key").sortWithinPartitions("key", "part", "at").mapInArrow(_ends, "key binary, ends_sha256 string"))
    shas = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")

    # The root's row is made of sums alone.
    spark = nodes.sparkSession
    convs_row = convs.agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")).first()
    below = nodes.agg(F.count_if(F.col("depth") == 1).alias("kids"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), F.lit(0)).alias("saved")).first()
    kind = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    bare = ends.where(F.col("key") == none).first()
    top = [(convs_row.least, 0, None, convs_row.n, below.kids, max(below.leaves, 1), below.saved, bare.ends_sha256 if bare else hashlib.sha256().hexdigest())]
    root = spark.createDataFrame(top if convs_row.n else [], kind)
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("fan"))
    parents = checkpoint(parents.unionByName(root.select(none.alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("fan"))))
    rows = nodes.join(sums, "key").join(ends, "key", "left").select(F.col("conv").alias("conv_id"), "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", shas)
    return root.unionByName(join_heavy(rows, parents, "parent", "fan").select(root.columns))


def _head(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 6


def rebuilt(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations that begin as the first of their hundred does.

    Conversation c takes the first h turns of c - c % 100, or all if it has fewer,
    and goes on with its own after its first h, where h is the CRC-32 of its
    decimal id modulo 6.
    """
    plan = lengths.select("conv", "n", (F.col("conv") - F.col("conv") % 100).alias("base"), _head(F.col("conv")).alias("h"))
    plan = plan.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = checkpoint(plan.select("conv", "n", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m")))
    own = join_heavy(turns, plan.select("conv", "n", "h", "m"), "conv", "n").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "chars")
    first = turns.where("conv % 100 = 0 AND pos < 6").withColumnRenamed("conv", "base")
    return first.join(plan, "base").where("pos <= h").select("conv", "pos", "digest", "chars").unionByName(own), plan.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return prefix_trie(*rebuilt(*turn_digests(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
#: CRC-32 of a decimal, bit by bit; every prefix is told by a chain of digests.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
            lambda c, d: list_reduce(list_concat([xor(c, d)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
ORACLES = {
    "op11_prefix_trie": f"""
        WITH RECURSIVE given AS MATERIALIZED (
            SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        plan AS MATERIALIZED (SELECT conv, conv - conv % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv FROM given)),
        turns AS MATERIALIZED (
            SELECT conv, role, text, row_number() OVER (PARTITION BY conv ORDER BY own, pos) AS pos FROM (
                SELECT p.conv, g.role, g.text, g.pos, 0 AS own FROM plan p JOIN given g ON g.conv = p.base AND g.pos <= p.h
                UNION ALL SELECT p.conv, g.role, g.text, g.pos, 1 FROM plan p JOIN given g ON g.conv = p.conv AND g.pos > p.h)),
        walk AS (
            SELECT conv, 0::BIGINT AS depth, '' AS key, '' AS parent, 0::BIGINT AS chars FROM plan
            UNION ALL
            SELECT w.conv, w.depth + 1, sha256(w.key || length(t.role) || ':' || t.role || t.text), w.key, length(t.text) FROM walk w JOIN turns t ON t.conv = w.conv AND t.pos = w.depth + 1),
        path AS MATERIALIZED (SELECT * FROM walk),
        ends AS (SELECT conv, max(depth) AS depth FROM path GROUP BY conv),
        node AS MATERIALIZED (
            SELECT depth, key, min(conv) AS conv, count(*) AS n_convs, any_value(parent) AS parent, any_value(chars) AS chars,
                   sha256(coalesce(string_agg(CASE WHEN last = depth THEN CAST(conv AS VARCHAR) END, ',' ORDER BY conv), '')) AS ends_sha256
            FROM (SELECT p.*, e.depth AS last FROM path p JOIN ends e ON e.conv = p.conv) GROUP BY depth, key),
        kids AS MATERIALIZED (SELECT parent AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
        sums AS (
            SELECT a.key, CAST(count(*) FILTER (k.key IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens
            FROM node n JOIN path a ON a.conv = n.conv AND a.depth <= n.depth LEFT JOIN kids k ON k.key = n.key GROUP BY a.key)
        SELECT n.conv AS conv_id, n.depth, CASE WHEN n.depth > 0 THEN u.conv END AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM node n JOIN sums s ON s.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN node u ON u.key = n.parent AND u.depth = n.depth - 1""",
}
