"""A training-data pipeline over ``documents``.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet in the folder that the
cluster shares and reads again as the next stage's ``docs``. All stages but the
last return the columns of ``documents``, whatever further ones there are.

Rows are told apart by id and text, so rows that repeat an id but not the text
are documents of their own in every stage. Null texts count as empty; an empty
table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import jaccard_join, line_dedup, mixing, pieces, toxicity
from corpusforge.llm.common import checkpoint, remove_folder, row_hash, shared_folder, sized_broadcast, small_batches, table

#: SQL cannot express the fitted grammar, the forest or the piece lattice.
ORACLE_SQL = None
#: The mix takes each document once at most, and this share of all tokens.
MIX_EPOCHS, MIX_SHARE = 1, 0.9
#: Units that the encoder holds: executors still hold what earlier stages left.
HELD = 100_000


def _among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """A semi or anti join of documents with rows (doc_id, row), null-safe."""
    keys = checkpoint(rows.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct())
    small = sized_broadcast(keys)
    return docs.join(small, docs["doc_id"].eqNullSafe(small["__id"]) & (row_hash("text") == small["__row"]), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go.

    Null and empty texts score 0 and stay. Of rows that repeat an id, each is
    scored by itself. Documents without labels, and no labels at all, are scored
    by the fixed grammar.
    """
    small_batches(spark)
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines go; so do documents left empty by it.

    Documents that were empty or null stay, as the empty text. Rows that repeat
    id and text lose the same lines. ``n_chars`` counts what is left.
    """
    small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = line_dedup.line_dedup(docs, carry=tuple(others)).where("n_dropped = 0 OR text <> ''")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("carried")[c] for c in others}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the least id stays.

    Of rows that repeat an id within a class, the one with the least text hash
    stays; of rows that repeat id and text, any one. A null id counts as the
    last. Texts without words are in no class and stay.
    """
    small_batches(spark)
    members, _ = jaccard_join.jaccard_join(docs)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("class_row"))
    members = checkpoint(members.select("doc_id", "row", first.alias("first"), F.col("node").isNotNull().alias("worded")))
    kept = _among(docs, members.where("NOT first"), "left_anti")
    repeated = checkpoint(members.where("first AND worded").groupBy("doc_id", "row").count().where("count > 1"))
    if repeated.isEmpty():
        return kept
    return _among(kept, repeated, "left_anti").unionByName(_among(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the target weights.

    A null language or source is a leaf of its own name "". Rows that repeat id
    and text stay or go together. Empty documents go with the prefix of their
    leaf that they fall in; a leaf without any tokens goes.
    """
    small_batches(spark)
    chosen = mixing.mix(docs, mixing.TARGET, mixing.tree_levels(), budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS)
    return _among(docs, chosen, "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the pieces, their number and digests of a round trip.

    One row per document, repeated ones too; null and empty texts have no ids.
    """
    small_batches(spark)
    return pieces.piece_digests(docs, model=pieces.model_path(spark), held=HELD)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_similar),
    ("mixing sources", mix_sources),
    ("piece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote goes once the next one has."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
