"""Feedback laid out for nesting: bucketed by (review, chunk), so reading reviews moves no feedback.

The service finds the files of a review by an index on ``review_id``.  Here the rows of all committed
runs are numbered within their reviews once, cut into chunks of ``chunk_files`` files and written in
buckets by (review_id, chunk), sorted by both.  A reader groups each bucket where it lies; only the
headers and one small row per review are dealt anew.  A review that holds a large share of all files
spreads over the buckets by its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions import text as tx
from codesieve.operators import store
from codesieve.operators.ranks import rank_within

ORDER = ["file_path", "id", "classification", "feedback", "created_at"]


def lay_out_feedback(feedback: DataFrame, table: str, path: str, buckets: int = 200, chunk_files: int = 1000) -> DataFrame:
    """``feedback`` written to ``path`` as the bucketed table ``table``; returns the table.

    The table is registered in the session's catalog, which knows its buckets; :func:`laid_out` registers an
    existing one in another session.
    """
    if chunk_files < 1 or buckets < 1:
        raise ValueError("buckets and chunk_files must be >= 1")
    chunk = F.floor((F.col("_rank") - 1) / F.lit(chunk_files)).cast("bigint")
    ranked = rank_within(feedback.select(*store.FEEDBACK_COLS), ["review_id"], ORDER, "_rank").withColumn("chunk", chunk).drop("_rank")
    # dealt as the buckets are, so each task writes whole buckets and not a piece of every one
    (ranked.repartition(buckets, "review_id", "chunk").write.bucketBy(buckets, "review_id", "chunk").sortBy("review_id", "chunk")
     .option("path", path).format("parquet").saveAsTable(table))
    return feedback.sparkSession.table(table)


def laid_out(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """The table of files that ``lay_out_feedback`` wrote with so many buckets, in a session that does not know it."""
    columns = ", ".join(f"{c} {t}" for c, t in (("id", "BIGINT"), ("review_id", "BIGINT"), ("file_path", "STRING"), ("classification", "STRING"),
                                                ("feedback", "STRING"), ("created_at", "TIMESTAMP_NTZ"), ("chunk", "BIGINT")))
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (review_id, chunk) "
              f"SORTED BY (review_id, chunk) INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def nested_reviews(reviews: DataFrame, repositories: DataFrame, table: DataFrame) -> DataFrame:
    """J3 + A2 over a table of ``lay_out_feedback``: what ``store.get_review`` gives for all reviews, chunk by chunk."""
    files = table.groupBy("review_id", "chunk").agg(F.sort_array(F.collect_list(F.struct(
        "file_path", "id", "classification", "feedback", tx.iso_timestamp("created_at").alias("created_at")))).alias("files"))
    # one row per review leaves the buckets; the headers are dealt to the chunks, not the chunks to the headers
    last = table.groupBy(F.col("review_id").alias("_review")).agg(F.max("chunk").alias("_last"))
    base = store.review_with_repo(reviews, repositories)
    headers = (base.join(last, base["id"] == F.col("_review"), "left")
               .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_last", F.lit(0).cast("bigint")))))
               .drop("_review", "_last"))
    j = headers.join(files.withColumnRenamed("chunk", "_chunk"), (F.col("id") == F.col("review_id")) & (F.col("chunk") == F.col("_chunk")), "left")
    empty = F.array().cast(files.schema["files"].dataType)
    return j.select("id", "repository", "commit", "branch", "pr_url", "created_at", "chunk", F.coalesce("files", empty).alias("files"))
