"""Repository, review and feedback rows.

Tables are plain DataFrames with the schemas of :mod:`codesieve.schema`.
Functions that make rows take ``start``, the run's first id
(:func:`codesieve.operators.ids.first_id`): ids depend on the run alone, so
a run that is redone gives the same ids and two runs never share one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.functions import text as tx
from codesieve.functions import urls
from codesieve.operators.ids import dense_ids
from codesieve.operators.ranks import rank_within

REPO_COLS = ["id", "owner", "name", "url", "last_reviewed_commit", "created_at", "updated_at"]
REVIEW_COLS = ["id", "repository_id", "commit_sha", "branch", "pr_url", "created_at"]
FEEDBACK_COLS = ["id", "review_id", "file_path", "classification", "feedback", "created_at"]


def ts_literal(ts: dt.datetime) -> Column:
    """A naive timestamp literal (TIMESTAMP_NTZ), independent of the session time zone."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# K2 upsert, K3/K4 append, K5 high-water mark
# ---------------------------------------------------------------------------

def new_repositories(existing: DataFrame, incoming_urls: DataFrame, run_ts: dt.datetime, start: int,
                     url_col: str = "url") -> DataFrame:
    """K2: one row per unseen, parsable URL, with ids after ``start`` in URL order."""
    incoming = incoming_urls.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    new = incoming.join(existing.select("url"), "url", "left_anti")
    parsed = new.select("url", urls.parse_repo_url("url").alias("p")).where(F.col("p.owner").isNotNull())
    ts = ts_literal(run_ts)
    rows = parsed.select(F.col("p.owner").alias("owner"), F.col("p.name").alias("name"), "url",
                         F.lit(None).cast("string").alias("last_reviewed_commit"),
                         ts.alias("created_at"), ts.alias("updated_at"))
    return dense_ids(rows, ["url"], start).select(*REPO_COLS)


def upsert_repositories(existing: DataFrame, incoming_urls: DataFrame, run_ts: dt.datetime, start: int,
                        url_col: str = "url") -> DataFrame:
    """K2: the repositories table with its new rows; known URLs are reused, unparsable ones left out."""
    return existing.select(*REPO_COLS).unionByName(new_repositories(existing, incoming_urls, run_ts, start, url_col))


def append_rows(table: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
    """K3 / K4: the table with rows appended (by name)."""
    return table.select(*cols).unionByName(rows.select(*cols))


def advance_watermark(repositories: DataFrame, runs: DataFrame, run_ts: dt.datetime,
                      only_changed: bool = False) -> DataFrame:
    """K5: ``last_reviewed_commit`` = reviewed head and ``updated_at`` refreshed for repositories with a run.

    ``only_changed`` leaves out the repositories without a run: what a run writes.
    """
    r = runs.select(F.col("repo_url").alias("url"), F.col("head_snapshot").alias("_head")).distinct()
    j = repositories.join(r, "url", "inner" if only_changed else "left")
    hit = F.col("_head").isNotNull()
    return j.select("id", "owner", "name", "url",
                    F.when(hit, F.col("_head")).otherwise(F.col("last_reviewed_commit")).alias("last_reviewed_commit"),
                    "created_at",
                    F.when(hit, ts_literal(run_ts)).otherwise(F.col("updated_at")).alias("updated_at"))


# ---------------------------------------------------------------------------
# P8 run descriptors, K3 headers, K4 feedback rows, A1 summary
# ---------------------------------------------------------------------------

def run_keys(df: DataFrame) -> list[str]:
    """What tells runs apart: the request, where requests are numbered, else the repository."""
    return ["request_id"] if "request_id" in df.columns else ["repo_url"]


def review_headers(runs: DataFrame, run_ts: dt.datetime, start: int) -> DataFrame:
    """P8 + K3: one new review header per run, ids after ``start`` in repository (then request) order."""
    p = urls.parse_repo_url(F.col("repo_url"))
    branch = F.concat(F.lit(rules.REVIEW_BRANCH_PREFIX), F.substring("head_snapshot", 1, rules.SHORT_SHA))
    link = F.concat(F.lit("https://github.com/"), p.getField("owner"), F.lit("/"), p.getField("name"),
                    F.lit("/pull/new/"), branch)
    keys = [k for k in (*run_keys(runs), "review_id") if k != "repo_url" and k in runs.columns]
    h = runs.select(
        *keys, "repo_url", "repository_id", "mode",
        F.col("head_snapshot").alias("commit_sha"),
        branch.alias("branch"),
        link.alias("pr_url"),
        F.concat(F.lit("Automated Review "), F.substring("head_snapshot", 1, rules.SHORT_SHA)).alias("pr_title"),
        F.concat(F.lit("Automated review for "), F.col("head_snapshot")).alias("commit_message"),
        ts_literal(run_ts).alias("created_at"))
    if "review_id" in runs.columns:  # numbered when the run was planned
        return h.withColumnRenamed("review_id", "id")
    return dense_ids(h, ["repo_url", *keys], start)


def feedback_rows(reviewed: DataFrame, headers: DataFrame, run_ts: dt.datetime, start: int) -> DataFrame:
    """K4: file_feedback rows of this run; ids after ``start`` in (review_id, file_path) order."""
    keys = run_keys(headers)
    j = reviewed.join(headers.select(*keys, F.col("id").alias("review_id")), keys, "inner")
    rows = j.select("review_id", F.col("path").alias("file_path"), "classification", "feedback",
                    ts_literal(run_ts).alias("created_at"))
    return dense_ids(rows, ["review_id", "file_path"], start).select(*FEEDBACK_COLS)


def review_summary(headers: DataFrame, new_feedback: DataFrame) -> DataFrame:
    """A1: (repository, commit, files_reviewed, pr_url, review_id, mode) per run; 0 when nothing was reviewed."""
    counts = new_feedback.groupBy("review_id").agg(F.count(F.lit(1)).alias("files_reviewed"))
    j = headers.join(counts, headers["id"] == counts["review_id"], "left")
    return j.select(F.col("repo_url").alias("repository"), F.col("commit_sha").alias("commit"),
                    F.coalesce("files_reviewed", F.lit(0)).cast("bigint").alias("files_reviewed"),
                    "pr_url", F.col("id").alias("review_id"), "mode")


# ---------------------------------------------------------------------------
# J1 / O1 / P11 listing, J2 / J3 / A2 one review
# ---------------------------------------------------------------------------

def check_limit(limit: int | None) -> int:
    """Page size default 20, must be within 1..100."""
    n = rules.LIST_LIMIT_DEFAULT if limit is None else limit
    if not rules.LIST_LIMIT_MIN <= n <= rules.LIST_LIMIT_MAX:
        raise ValueError(f"limit must be within {rules.LIST_LIMIT_MIN}..{rules.LIST_LIMIT_MAX}")
    return n


def _review_listing(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    r = repositories.select(F.col("id").alias("_rid"), F.col("url").alias("repository"), "owner", "name")
    j = reviews.join(r, reviews["repository_id"] == r["_rid"], "inner")
    return j.select("id", "repository", "owner", "name", F.col("commit_sha").alias("commit"), "branch", "pr_url",
                    "created_at")


def list_reviews(reviews: DataFrame, repositories: DataFrame, repo: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """J1 + O1 + P11: newest reviews first (ties by id), the repository filter applied before the limit."""
    n = check_limit(limit)
    if repo:
        # url is unique, so the filtered side holds at most one row
        repositories = F.broadcast(repositories.where(F.col("url") == repo))
    out = _review_listing(reviews, repositories)
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n) \
        .withColumn("created_at", tx.iso_timestamp("created_at"))


def list_reviews_per_repo(reviews: DataFrame, repositories: DataFrame, limit: int | None = None) -> DataFrame:
    """P11 for every repository at once: its newest ``limit`` reviews (a per-repository top-k)."""
    n = check_limit(limit)
    out = _review_listing(reviews, repositories)
    w = Window.partitionBy("repository").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= F.lit(n))
            .withColumn("position", F.col("position").cast("bigint"))
            .withColumn("created_at", tx.iso_timestamp("created_at")))


def review_with_repo(reviews: DataFrame, repositories: DataFrame) -> DataFrame:
    """Each review with its repository URL, null when the repository is gone."""
    r = repositories.select(F.col("id").alias("_rid"), F.col("url").alias("repository"))
    j = reviews.join(r, reviews["repository_id"] == r["_rid"], "left")
    return j.select("id", "repository", F.col("commit_sha").alias("commit"), "branch", "pr_url",
                    tx.iso_timestamp("created_at").alias("created_at"))


def review_files_of(reviews: DataFrame, repositories: DataFrame, feedback: DataFrame,
                    review_id: int | None = None) -> DataFrame:
    """J3, flat: one row per review and file (one row with null file columns for a review without files)."""
    if review_id is not None:
        reviews = reviews.where(F.col("id") == review_id)
        feedback = feedback.where(F.col("review_id") == review_id)
    f = feedback.select("review_id", "file_path", F.col("id").alias("feedback_id"), "classification", "feedback",
                        tx.iso_timestamp("created_at").alias("feedback_created_at"))
    base = review_with_repo(reviews, repositories)
    return base.join(f, base["id"] == f["review_id"], "left").drop("review_id")


def get_review(reviews: DataFrame, repositories: DataFrame, feedback: DataFrame,
               review_id: int | None = None, chunk_files: int = 1000) -> DataFrame:
    """J3 + A2: nested rows per review (one id, or all), files ordered by path, id, then the other fields.

    A review of any number of files is cut into chunks 0, 1, ... of ``chunk_files`` files, so no row and
    no task holds more; the files of a review are numbered by :func:`rank_within`, which spreads a large
    review over many tasks.  A review without files is one row, chunk 0, with an empty list.
    """
    if chunk_files < 1:
        raise ValueError("chunk_files must be >= 1")
    if review_id is not None:
        reviews = reviews.where(F.col("id") == review_id)
        feedback = feedback.where(F.col("review_id") == review_id)
    order = ["file_path", "id", "classification", "feedback", "created_at"]
    ranked = rank_within(feedback.select(*FEEDBACK_COLS), ["review_id"], order, "_rank")
    chunk = F.floor((F.col("_rank") - 1) / F.lit(chunk_files)).cast("bigint")
    files = (ranked.withColumn("chunk", chunk).groupBy("review_id", "chunk").agg(F.sort_array(F.collect_list(F.struct(
        "file_path", "id", "classification", "feedback",
        tx.iso_timestamp("created_at").alias("created_at")))).alias("files")))
    base = review_with_repo(reviews, repositories)
    j = base.join(files, base["id"] == files["review_id"], "left")
    empty = F.array().cast("array<struct<file_path:string,id:bigint,classification:string,feedback:string,"
                           "created_at:string>>")
    return j.select("id", "repository", "commit", "branch", "pr_url", "created_at",
                    F.coalesce("chunk", F.lit(0).cast("bigint")).alias("chunk"), F.coalesce("files", empty).alias("files"))


# ---------------------------------------------------------------------------
# P9 request validation
# ---------------------------------------------------------------------------

def validate_requests(requests: DataFrame, repo: str = "repo", mode: str = "mode",
                      limit: str = "page_limit") -> DataFrame:
    """P9 for a table of requests: effective mode and limit, and a reject reason instead of an error."""
    lim = F.coalesce(F.col(limit), F.lit(rules.LIST_LIMIT_DEFAULT))
    reason = (F.when(F.col(repo).isNull() | (F.col(repo) == ""), F.lit("missing repo"))
              .when((lim < rules.LIST_LIMIT_MIN) | (lim > rules.LIST_LIMIT_MAX), F.lit("limit out of range")))
    mode_col = F.lower(F.coalesce(F.nullif(F.col(mode), F.lit("")), F.lit(rules.DEFAULT_MODE)))
    return requests.select("*", mode_col.alias("effective_mode"), lim.cast("bigint").alias("effective_limit"),
                           reason.isNull().alias("valid"), reason.alias("reason"))
