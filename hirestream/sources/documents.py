"""Whole-file document source."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: readable extensions -----------------------------------------
TEXT_EXTENSIONS = ["txt", "md"]
# -------------------------------------------------------------------------------


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row per file ``(path, text)``; files with an unsupported extension go
    to the reject table instead (binary formats need a codec outside Spark)."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
           .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    ok = ext.isin(TEXT_EXTENSIONS)
    return raw.filter(ok), raw.filter(~ok).select("path", F.lit("unsupported extension").alias("reason"))
