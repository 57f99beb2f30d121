"""Detection on streams: it keeps no state, so it runs on each micro-batch as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.operators.detection import detect
from lakesift.sources.files import plain_text


def detect_stream(spark: SparkSession, root: str) -> DataFrame:
    """A stream of decisions on the text files that arrive under ``root``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    named = files.withColumns({"name": F.substring_index("path", "/", -1), "top_dir": F.lit("text"), "text": plain_text(F.col("content"))})
    return detect(named.drop("content"))
