"""Images of documents: numbering, naming, placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import image_file, image_name, image_status, image_type, safe_name

#: Stands for an image that cannot be shown; callers give the address of their own.
PLACEHOLDER = "./images/placeholder.png"


def name_images(images: DataFrame, doc: str = "doc_id", doc_name: str = "doc_name", position: str = "pos", placeholder: str = PLACEHOLDER) -> DataFrame:
    """doc, seq, image_type, name, status, src of rows with content_type and b64_len.

    Numbers go by position within a document, and images that are not shown
    take one as well.
    """
    kind = image_type(F.col("content_type"))
    rows = images.withColumn("image_type", kind).withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy(position)))
    rows = rows.withColumn("status", image_status(F.col("image_type"), F.col("b64_len")))
    rows = rows.withColumn("name", image_file(image_name(F.col(doc_name), F.col("seq"), F.col("image_type")), F.col("image_type")))
    src = F.when(F.col("status") == "ok", F.concat(F.lit("./images/"), safe_name(F.col(doc_name)), F.lit("/"), "name")).otherwise(placeholder)
    return rows.select(doc, "seq", "image_type", "name", "status", src.alias("src"))


def image_types(images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: the distinct types that were handled."""
    kind = image_type(F.col("content_type"))
    shown = images.select(kind.alias("k")).where(~F.col("k").isin("x-emf", "gif", "wmf", "emf"))
    return shown.agg(F.array_sort(F.collect_set("k")).alias("types"))
