"""Documents that keep arriving: the same chunker on a stream of context files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotusrank.operators.chunking import chunk_each, cleaned


def chunk_stream(docs: DataFrame) -> DataFrame:
    """A stream of (doc_id, name, link, passage) as a stream of chunks of all tiers, without state: each document is cut by itself."""
    return chunk_each(cleaned(docs))


def latest(docs: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of crawled rows without repeats that come within `late` of each other by crawl time."""
    return docs.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["doc_id"])


def run(spark: SparkSession, source: str, target: str, state: str) -> StreamingQuery:
    """Chunks all parquet files that appear under `source` into `target`, once each, and stops when it has caught up."""
    schema = "doc_id string, name string, link string, passage string, crawled_at timestamp_ntz"
    docs = spark.readStream.schema(schema).parquet(source).withColumn("crawled_at", F.col("crawled_at").cast("timestamp"))
    return chunk_stream(latest(docs)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(target)
