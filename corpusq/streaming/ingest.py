"""Files that keep arriving: the readers over a stream of whole files. An extension; corpora themselves are built in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusq.sources.readers import ConlluReader


def stream_rows(spark: SparkSession, path: str, pattern: str = "*.conllu") -> DataFrame:
    """Parsed rows of files as they arrive in a folder; parsing needs no state."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    return ConlluReader().parse(files.select(F.col("_metadata.file_path").alias("file"), "value")).rows


def append_rows(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*.conllu") -> StreamingQuery:
    """Append the rows of all files not seen yet to a parquet table, each file once, and stop."""
    return stream_rows(spark, path, pattern).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
