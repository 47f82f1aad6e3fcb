"""Cross-document links: extraction, resolution and rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jstext import WS_INNER, trim
from ..functions.names import POINTING
from ..plans.shared import kept

#: The pattern of a mention and the address of the manual.
#: A directory word has none of the letters p, n, g and no dot: the original
#: pattern lists them in a character class.
_DIR = rf"[^>.png{WS_INNER}]+"
_NAME = rf"[^.{WS_INNER}]+"
LINK = rf"([0-9]+\.{_DIR}(?:[ \t]+{_DIR})*) > ({_NAME}(?:[ \t]+{_NAME})*)\.docx"
BASE = "/docx/插件详细手册"
#: Hits are broadcast up to this size, by a measuring pass.
BROADCAST_BYTES = 16 << 20
#: An index of at most so many names is part of the expression that looks them up.
SMALL_INDEX = 4096
#: Bits of the largest filter, 2 MB, and how many of them stand for a row.
FILTER_BITS, _HASHES = 1 << 24, 3


def links_of(content: Column) -> Column:
    """array of (dir, name) in the order of the text."""
    found = F.regexp_extract_all(content, F.lit(LINK), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, LINK, 1).alias("dir"), F.regexp_extract(m, LINK, 2).alias("name")))


def render(folder: Column, name: Column, pointing: Column) -> Column:
    mark = F.when(pointing, POINTING).otherwise("")
    return F.concat(F.lit("[`"), folder, F.lit(" > "), name, F.lit(f".docx`]({BASE}/"), folder, F.lit("/"), mark, name, F.lit(".md)"))


def extract_links(docs: DataFrame, pointing: DataFrame, keys: tuple[str, ...] = ("path",), content: str = "content") -> DataFrame:
    """A row per mention: keys, seq, dir, name, pointing, target.

    The pointing index is joined by (dir, name); Spark broadcasts it by its
    size or shuffles both sides.
    """
    mentions = docs.select(*keys, F.posexplode(links_of(F.col(content))).alias("seq", "link")).select(*keys, "seq", "link.dir", "link.name", trim(F.col("link.name")).alias("key"))
    known = pointing.select("dir", F.col("name").alias("key")).distinct().withColumn("pointing", F.lit(True))
    joined = mentions.join(known, ["dir", "key"], "left").withColumn("pointing", F.coalesce("pointing", F.lit(False)))
    target = F.concat(F.lit(BASE + "/"), "dir", F.lit("/"), F.when(F.col("pointing"), POINTING).otherwise(""), "name", F.lit(".md"))
    return joined.select(*keys, "seq", "dir", "name", "pointing", target.alias("target"))


def _bit(at: Column) -> Column:
    """The bit of a place within its byte."""
    return F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int"))


def bloom(known: DataFrame, *columns: str) -> bytes:
    """A Bloom filter of rows, as bytes for the driver: FILTER_BITS bits at most.

    Built by one aggregation of bits; with more rows than it has room for it lets
    more through and never loses one.
    """
    n = known.count()
    size = min(FILTER_BITS, max(1 << 13, 1 << (10 * n).bit_length()))
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), *columns), F.lit(size)) for k in range(_HASHES)])).alias("at")
    bits = known.select(places).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(_bit(F.col("at"))).alias("bits"))
    out = bytearray(size // 8)
    for r in bits.collect():
        out[r.byte] = r.bits
    return bytes(out)


def may_hold(filled: bytes, *values: Column) -> Column:
    """False for rows that the filter was certainly not made of."""
    size = 8 * len(filled)

    def bit(k: int) -> Column:
        at = F.pmod(F.xxhash64(F.lit(k), *values), F.lit(size))
        byte = F.conv(F.hex(F.substr(F.lit(filled), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(_bit(at)) != 0

    return reduce(Column.__and__, [bit(k) for k in range(_HASHES)])


def rewrite_links(docs: DataFrame, pointing: DataFrame, content: str = "content", broadcast_bytes: int = BROADCAST_BYTES, small_index: int = SMALL_INDEX) -> DataFrame:
    """``docs`` with every mention in ``content`` turned into a link.

    The pieces of a text are put together by position, so a mention that is a
    part of another is never replaced inside it.

    Contents stay where they are read. An index of at most ``small_index`` names is
    looked up within the row, in one pass. Of a larger one, a first look takes from
    each text the mentions that a Bloom filter of the index lets through, and only
    these, with a digest of the text, are joined with the index by (dir, name). What
    they hit is found again by the digest: texts that are equal have equal links, so
    rows need no key of their own. If the hits are larger than ``broadcast_bytes``,
    the texts that the filter lets through are shuffled to them, and no others.
    """
    known = kept(pointing.select("dir", F.col("name").alias("key")).where("dir IS NOT NULL AND name IS NOT NULL").distinct())
    c = F.col(content)

    def rewritten(rows: DataFrame, hit) -> DataFrame:
        """``hit`` tells of a mention's (dir, name) whether it is in the index."""
        rendered = F.transform("__links", lambda l: render(l["dir"], l["name"], hit(l["dir"], trim(l["name"]))))
        text = F.array_join(F.flatten(F.zip_with(F.split(c, LINK, -1), rendered, lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), "")
        whole = F.when(F.size("__links") > 0, text).otherwise(c)
        return rows.select(*[(whole if x == content else F.col(f"`{x}`")).alias(x) for x in docs.columns])

    linked = docs.withColumn("__links", links_of(c))
    few = known.limit(small_index + 1).collect() if small_index else []
    if small_index and len(few) <= small_index:
        # One literal, not one for each name: no file name holds a NUL.
        names = F.lit("".join(f"\0\0{r.dir}\0{r.key}\0\0" for r in few))
        return rewritten(linked, lambda d, k: F.contains(names, F.concat(F.lit("\0\0"), d, F.lit("\0"), k, F.lit("\0\0"))) & ~F.contains(F.concat(d, k), F.lit("\0")))

    filled = bloom(known, "dir", "key")
    likely = F.filter(F.array_distinct(F.transform("__links", lambda m: F.struct(m["dir"].alias("dir"), trim(m["name"]).alias("key")))), lambda m: may_hold(filled, m["dir"], m["key"]))
    keyed = linked.withColumn("__sha", F.sha2(c, 256))
    asked = keyed.select("__sha", F.explode(likely).alias("m")).select("__sha", "m.dir", "m.key")
    hits = kept(asked.join(known, ["dir", "key"]).groupBy("__sha").agg(F.collect_set(F.struct("dir", "key")).alias("__hits")))

    def among(d: Column, k: Column) -> Column:
        return F.coalesce(F.array_contains("__hits", F.struct(d.alias("dir"), k.alias("key"))), F.lit(False))

    size = hits.agg(F.sum(F.octet_length(F.to_json("__hits")) + 96)).first()[0] or 0
    if size <= broadcast_bytes:
        return rewritten(keyed.join(F.broadcast(hits), "__sha", "left"), among)
    through = F.coalesce(F.size(likely) > 0, F.lit(False))
    return rewritten(keyed.where(through).join(hits, "__sha", "left"), among).unionByName(rewritten(linked.where(~through), lambda d, k: F.lit(False)))


def dangling_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links whose target (with its marker, if any) is not in the catalog."""
    wanted = links.withColumn("__name", F.concat(F.when(F.col("pointing"), POINTING).otherwise(""), "name"))
    known = names.select("dir", F.col("name").alias("__name")).distinct()
    return wanted.join(known, ["dir", "__name"], "left_anti").drop("__name")
