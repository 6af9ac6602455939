"""Table schemas (K1).

The three stored tables keep the column set of the reviewed service; the
file snapshot and refs tables are the inputs of a many-repository run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REPOSITORIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("owner", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("url", T.StringType(), False),
    T.StructField("last_reviewed_commit", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])

REVIEWS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("repository_id", T.LongType(), True),
    T.StructField("commit_sha", T.StringType(), True),
    T.StructField("branch", T.StringType(), True),
    T.StructField("pr_url", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

FILE_FEEDBACK = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("review_id", T.LongType(), True),
    T.StructField("file_path", T.StringType(), True),
    T.StructField("classification", T.StringType(), True),
    T.StructField("feedback", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

FILES = T.StructType([
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("snapshot_id", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
])

REFS = T.StructType([
    T.StructField("repo_url", T.StringType(), False),
    T.StructField("ref", T.StringType(), False),
    T.StructField("snapshot_id", T.StringType(), False),
])

# What became of every request of a run: planned before anything else is written.
OUTCOMES = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("repo_url", T.StringType(), True),
    T.StructField("mode", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("reason", T.StringType(), True),
    T.StructField("repository_id", T.LongType(), True),
    T.StructField("base_snapshot", T.StringType(), True),
    T.StructField("head_snapshot", T.StringType(), True),
    T.StructField("review_id", T.LongType(), True),
])

# Selected files that could not be reviewed.
FILE_REJECTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("repo_url", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
])

TABLES = {"repositories": REPOSITORIES, "reviews": REVIEWS, "file_feedback": FILE_FEEDBACK,
          "outcomes": OUTCOMES, "planned_repositories": REPOSITORIES, "file_rejects": FILE_REJECTS}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
