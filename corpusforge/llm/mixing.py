"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a domain - language - source tree hold documents. A token budget
goes down the tree by the weights of siblings. No node gets more than its
subtree can give in ``max_epochs``; what it cannot take goes to its siblings by
their weights, and only what no sibling can take is left to the siblings of its
parent (a parent never gets more than its children can take together).

A leaf with budget B and T tokens gives B // T whole epochs and, of the next
one, the prefix of a seeded order whose tokens fit in the rest. The end of the
prefix is found by histograms over ranges of the order's hash, each round only
within the range that holds the end, so no leaf is ever sorted as a whole. The
driver sees the tree alone: the tokens and the budget of each leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, row_hash, sized_broadcast, small_batches, table, text_of

MAX_EPOCHS = 2
BUDGET_SHARE = 0.8
SEED = 7
#: Bits that a histogram round resolves, and rounds for each of the three words of
#: 56 bits that order the rows of an epoch.
BITS, ROUNDS = 8, 7
WORDS = ("w0", "w1", "w2")
#: A range with at most so many documents is ordered row by row.
RANGE_ROWS = 4096
#: Leaves of a tree, which the driver holds; a tree of more is refused.
MAX_LEAVES = 1_000_000


@dataclass
class Node:
    """weight among its siblings; children of a name not listed weigh ``other``."""

    weight: float = 1.0
    children: dict[str, Node] = field(default_factory=dict)
    other: float = 1.0


def share_out(budget: int, weights: list[float], capacities: list[int]) -> list[int]:
    """Split a budget by weights under capacities, whole tokens only.

    Parts that meet their capacity are fixed and the rest is split anew among
    the others. Nothing is left unless all capacities are met or weights are 0.
    """
    given = [0] * len(weights)
    free = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    left = budget
    while free and left > 0:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= capacities[i]]
        if not full:
            exact = [left * weights[i] / total for i in free]
            parts = [int(x) for x in exact]
            for k in sorted(range(len(free)), key=lambda k: (parts[k] - exact[k], k))[: left - sum(parts)]:
                parts[k] += 1
            for i, p in zip(free, parts, strict=True):
                given[i] = min(p, capacities[i])
            break
        for i in full:
            given[i] = capacities[i]
        left = budget - sum(given)
        free = [i for i in free if i not in set(full)]
    return given


def propagate(root: Node, tokens: dict[tuple[str, ...], int], budget: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """The budget of each leaf, from the tokens of each leaf."""
    out: dict[tuple[str, ...], int] = {}

    def down(node: Node, leaves: dict[tuple[str, ...], int], at: int, budget: int) -> None:
        groups: dict[str, dict] = {}
        for leaf, n in leaves.items():
            groups.setdefault(leaf[at], {})[leaf] = n
        names = sorted(groups)
        nodes = [node.children.get(x, Node(node.other)) for x in names]
        parts = share_out(budget, [n.weight for n in nodes], [max_epochs * sum(groups[x].values()) for x in names])
        for name, child, part in zip(names, nodes, parts, strict=True):
            (leaf, *more) = groups[name]
            if len(leaf) == at + 1:
                out[leaf] = part
            else:
                down(child, groups[name], at + 1, part)

    if tokens:
        down(root, tokens, 0, budget)
    return out


def _order(seed: int, epoch: Column) -> Column:
    """56 hash bits that order the documents of an epoch."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("id").cast("string")), 8)


def _words(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their place in the order of the partial epoch, as three words.

    The id decides, hashed with the epoch; of rows that repeat an id (null ids
    among them) the text's hash does, and of equal rows the place where they were
    read, which of them being chosen makes no difference.
    """
    top = F.lit(-(1 << 63)).bitwiseXOR(F.col("row"))
    return rows.withColumns({"w0": _order(seed, F.col("whole")), "w1": F.shiftrightunsigned(top, 8), "w2": F.shiftrightunsigned(F.xxhash64("n"), 8)})


def _cut(word: str, k: int) -> Column:
    """The first bits of a word that the range of a plan row fixes."""
    fixed = F.least(F.greatest(F.col("depth") * BITS - 56 * k, F.lit(0)), F.lit(56))
    return F.call_function("shiftright", F.col(word), (F.lit(56) - fixed).cast("int"))


def mix(df: DataFrame, root: Node, levels: list[Column], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """One row per chosen document and epoch: id, row, leaf (array), epoch, tokens.

    ``levels`` are the columns of the tree from the root down. The budget is
    ``budget_share`` times the tokens of the table; ``tokens`` counts those of a
    document (default: runs of non-blanks of its text). ``row`` is a hash of the
    text.

    Null levels count as the empty name. Null and empty texts have no tokens;
    they go with the prefix that they fall in. A leaf without any tokens gives
    nothing. Rows that repeat an id fall together in the order and go by
    ``row``; equal ones are chosen or left one by one. Empty table: no rows.
    Other columns are ignored. The driver holds the
    tree: more than ``max_leaves`` leaves are a ValueError.
    """
    spark = df.sparkSession
    count = tokens if tokens is not None else F.regexp_count(text_of(text_col), F.lit(r"\S+"))
    leaf = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in levels])
    docs = checkpoint(df.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), leaf.alias("leaf"), count.cast("long").alias("tokens"), F.monotonically_increasing_id().alias("n")))
    totals = docs.groupBy("leaf").agg(F.sum("tokens").alias("t")).limit(max_leaves + 1).collect()
    if len(totals) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    available = {tuple(r.leaf): r.t for r in totals}
    budgets = propagate(root, available, int(budget_share * sum(available.values())), max_epochs)

    # Whole epochs, tokens of the partial one, and the range of the order that holds
    # its end: its first ``depth`` steps of BITS bits, 0 while there is none.
    starts = [f"s{k}" for k in range(len(WORDS))]
    kind = T.StructType([T.StructField("leaf", T.ArrayType(T.StringType())), *[T.StructField(n, T.LongType()) for n in ("whole", "rest", "depth", *starts, "inside")]])
    rows = [(list(k), b // available[k], b % available[k], 0, 0, 0, 0, 0) for k, b in budgets.items() if b and available[k]]
    plan = checkpoint(spark.createDataFrame(rows, kind))
    done, todo = plan.where("rest = 0"), plan.where("rest > 0")
    for depth in range(ROUNDS * len(WORDS)):
        if todo.isEmpty():
            break
        # Only documents in the ranges that are still open are counted.
        at, low = depth // ROUNDS, 56 - BITS * (depth % ROUNDS + 1)
        h = _words(docs.join(sized_broadcast(todo), "leaf"), seed)
        for k in range(at):
            h = h.where(F.col(WORDS[k]) == F.col(starts[k]))
        h = h.where(F.shiftright(WORDS[at], low + BITS) == F.shiftright(starts[at], low + BITS))
        bins = h.groupBy("leaf", F.shiftright(WORDS[at], low).alias("bin")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        # At most 2**BITS rows of a leaf meet here.
        upto = F.sum("t").over(Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        passed = bins.withColumn("upto", upto).join(todo.select("leaf", F.col("rest").alias("goal")), "leaf").where("upto > goal")
        end = passed.groupBy("leaf").agg(F.min_by(F.struct("bin", "n", (F.col("upto") - F.col("t")).alias("below")), "bin").alias("e"))
        # A range without an end can not be: its tokens are more than the rest.
        plan = todo.join(end, "leaf").select("leaf", "whole", (F.col("rest") - F.col("e.below")).alias("rest"), F.lit(depth + 1).cast("long").alias("depth"), *[F.shiftleft("e.bin", low).alias(x) if k == at else F.col(x) for k, x in enumerate(starts)], F.col("e.n").alias("inside"))
        plan = checkpoint(plan)
        done, todo = done.unionByName(plan.where(f"inside <= {RANGE_ROWS}")), plan.where(f"inside > {RANGE_ROWS}")

    # Below the range: chosen. Inside it: chosen while the tokens fit.
    planned = checkpoint(done.unionByName(todo).drop("inside"))
    own = _words(docs.join(sized_broadcast(planned), "leaf"), seed)
    here, end = (F.array(*[_cut(x, k) for k, x in enumerate(names)]) for names in (WORDS, starts))
    edge = F.when(F.col("depth") == 0, 0).when(here == end, 1).when(here < end, 2).otherwise(0)
    own = own.withColumn("edge", edge)
    so_far = Window.partitionBy("leaf").orderBy("w0", "id", "row", "w2").rowsBetween(Window.unboundedPreceding, 0)
    inner = own.where("edge = 1").withColumn("upto", F.sum("tokens").over(so_far))
    epochs = F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)
    full = own.where("whole > 0").select("id", "row", "leaf", F.explode(epochs).alias("epoch"), "tokens")
    below = own.where("edge = 2").select("id", "row", "leaf", F.col("whole").alias("epoch"), "tokens")
    fits = inner.where("upto <= rest").select("id", "row", "leaf", F.col("whole").alias("epoch"), "tokens")
    return full.unionByName(below).unionByName(fits).withColumnRenamed("id", id_col)


#: The mix of the registered query and of the pipeline: production weights.
TARGET = Node(children={
    "web": Node(0.5, {"en": Node(0.6), "de": Node(0.15), "fr": Node(0.15), "es": Node(0.1)}),
    "books": Node(0.3, {"en": Node(0.5), "de": Node(0.2), "fr": Node(0.2), "es": Node(0.1)}),
    "forum": Node(0.2, {"en": Node(0.7), "de": Node(0.1), "fr": Node(0.1), "es": Node(0.1)}),
})


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to, by the rest of its number by 3."""
    number = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), (number % 3 + 1).cast("int"))


def tree_levels() -> list[Column]:
    return [domain_of(F.col("source")), F.col("lang"), F.col("source")]


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    chosen = mix(table(spark, sf_dir, "documents"), TARGET, tree_levels())
    return chosen.select("doc_id", F.col("leaf")[0].alias("domain"), F.col("leaf")[1].alias("lang"), F.col("leaf")[2].alias("source"), "epoch", "tokens")


QUERIES = {"op4_mixing": op4_mixing}
ORACLES: dict[str, str] = {}
