"""The corpus builder: listing, conversion, cleaning.

Conversion and cleaning meet in the plan, not on disk; word-processor files are
read once, when it is made. Each document carries
its status; ``errors`` splits failed ones off, and a failure never ends a run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaners import CHAIN, clean_frame, text_to_markdown
from ..functions.names import basename, file_stem, image_file, image_name, image_status, image_type, safe_name, target_path
from ..operators.catalog import catalog_rows, ignore_filter, pointing_rows
from ..operators.images import PLACEHOLDER
from ..operators.links import rewrite_links
from ..operators.plugins import clean_with_plugins, has_plugins, plugin_errors
from ..sources.config import BuildConfig
from ..sources.docx import docx_to_html
from ..sources.html import pages_to_markdown
from ..sources.listing import catalog_files, read_binaries, read_texts, scan
from .shared import kept, qualified

EMPTY_INDEX = "dir string, name string"


@dataclass
class Built:
    documents: DataFrame  # path, content
    images: DataFrame | None  # path, seq, name, status, src, data
    errors: DataFrame  # path, stage, error


def text_documents(texts: DataFrame, source_base: str, target: str) -> DataFrame:
    """path, source, content of plain-text files (path, content)."""
    return texts.select(target_path(F.col("path"), source_base, target).alias("path"), F.col("path").alias("source"), text_to_markdown(F.col("content"), F.col("path")).alias("content"))


def document_images(read: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Named images of read word-processor files, one row each."""
    rows = read.select("path", F.explode("images").alias("i")).select("path", "i.*")
    name = file_stem(basename(F.col("path")))
    kind = image_type(F.col("content_type"))
    rows = rows.withColumn("status", image_status(kind, F.col("b64_len"))).withColumn("name", image_file(image_name(name, F.col("seq"), kind), kind))
    src = F.when(F.col("status") == "ok", F.concat(F.lit("./images/"), safe_name(name), F.lit("/"), "name")).otherwise(placeholder)
    return rows.select("path", "seq", "name", "status", src.alias("src"), "data")


def place_images(read: DataFrame, images: DataFrame) -> DataFrame:
    """``html`` with every image's own address, put in by position."""
    srcs = images.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "src"))).alias("s")).select("path", F.col("s.src").alias("srcs"))
    joined = read.join(srcs, "path", "left")
    parts = F.split("html", r"image:[0-9]+(?=\x22>)", -1)
    filled = F.array_join(F.flatten(F.zip_with(parts, F.coalesce("srcs", F.array().cast("array<string>")), lambda g, s: F.array(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit(""))))), "")
    return joined.select("path", F.when(F.col("html").isNull(), F.lit(None)).otherwise(filled).alias("html"), "error")


def office_documents(files: DataFrame, source_base: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, source, content), images and errors of files (path, content)."""
    # Read once: html, images and errors are three looks at the same files.
    read = kept(docx_to_html(files))
    images = document_images(read)
    pages = place_images(read, images)
    bad = pages.where("error IS NOT NULL").select("path", F.lit("docx").alias("stage"), "error")
    converted = kept(pages_to_markdown(pages.where("error IS NULL")))
    bad = bad.unionByName(converted.where("error IS NOT NULL").select("path", F.lit("html").alias("stage"), "error"))
    good = converted.where("error IS NULL").select(target_path(F.col("path"), source_base, target).alias("path"), F.col("path").alias("source"), "content")
    return good, images, bad


def overwritten(targets: DataFrame) -> DataFrame:
    """(path, source) that another source of the same target path overwrites.

    Word-processor files win over plain texts; of equals the last by name does.
    Only paths are read and shuffled here, no content.
    """
    order = F.struct(F.lower(F.col("source")).rlike(r"\.docx?\z").alias("office"), F.col("source").alias("winner"))
    won = targets.groupBy("path").agg(F.max(order)["winner"].alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return targets.join(won, "path").where("source <> winner").select("path", "source")


def last_writer(documents: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per target path. ``targets`` (path, source) spares a second read
    of the contents where a listing has the same rows."""
    lost = overwritten(documents.select("path", "source") if targets is None else targets)
    return documents.join(lost, ["path", "source"], "left_anti").select("path", "content")


def clean_documents(documents: DataFrame, pointing: DataFrame, chain=CHAIN) -> DataFrame:
    """``content`` through the cleaners, then the links."""
    return rewrite_links(clean_frame(documents, chain=chain), pointing)


def clean_checked(documents: DataFrame, pointing: DataFrame, chain=CHAIN) -> tuple[DataFrame, DataFrame | None]:
    """Cleaned documents (path, content), and path, stage, error of failed ones.

    A document that a plug-in of the chain fails on stays as it was, without
    links too. A chain of column cleaners alone has no errors.
    """
    if not has_plugins(chain):
        return clean_documents(documents, pointing, chain), None
    # Worked out once: what is kept and what failed are two looks at it.
    cleaned = kept(clean_with_plugins(documents, chain=chain))
    good = rewrite_links(cleaned.where("failed IS NULL").select(documents.columns), pointing)
    return good.unionByName(cleaned.where("failed IS NOT NULL").select(documents.columns)), plugin_errors(cleaned)


def collisions(documents: DataFrame) -> DataFrame:
    """Target paths that several sources map to."""
    return documents.groupBy("path").agg(F.count_distinct("source").alias("n")).where("n > 1")


def build(spark: SparkSession, source: str, target: str, manual: str, config: BuildConfig | None = None, chain=CHAIN) -> Built:
    """Build the corpus below ``source``; ``manual`` is the folder of the catalog.

    ``chain`` names the cleaners, plug-ins among them, in their order.

    ``source`` is one folder, no pattern; the paths in the configuration are as
    Spark lists files.
    """
    config = config or BuildConfig()
    base = qualified(spark, source)

    def ours(files: DataFrame) -> DataFrame:
        """By path alone, so contents of ignored files are not read."""
        return ignore_filter(files, list(config.ignored_folders), list(config.ignored_files))

    listed = ours(scan(spark, source)).select("path")
    rows = catalog_rows(catalog_files(scan(spark, source), manual)) if not config.skip_data_preparation else spark.createDataFrame([], EMPTY_INDEX)
    errors = spark.createDataFrame([], "path string, stage string, error string")
    if config.skip_transform:
        return Built(spark.createDataFrame([], "path string, content string"), None, errors)
    texts = text_documents(ours(read_texts(spark, source)), base, target)
    office, images, bad = office_documents(ours(read_binaries(spark, source, "*.{doc,docx}")), base, target)
    wanted = listed.where(F.col("path").rlike(r"\.(txt|doc|docx)\z")).select(target_path(F.col("path"), base, target).alias("path"), F.col("path").alias("source"))
    wanted = wanted.join(bad.select(F.col("path").alias("source")), "source", "left_anti")
    documents = last_writer(texts.unionByName(office), wanted)
    failed = [errors, bad]
    if not config.skip_clean:
        documents, unclean = clean_checked(documents, pointing_rows(rows), chain)
        failed += [unclean] if unclean is not None else []
    return Built(documents, images, all_errors(failed))


def all_errors(parts: list[DataFrame]) -> DataFrame:
    """The error tables of several stages as one: path, stage, error."""
    return reduce(DataFrame.unionByName, [p.select("path", "stage", "error") for p in parts])


def report(built: Built) -> DataFrame:
    """stage, n: what failed, by stage; no row means that nothing did."""
    return built.errors.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
