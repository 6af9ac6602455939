"""End-to-end review run over many repositories at once.

One call answers a batch of review requests: every request gets an outcome
(a review, or the reason why not), every accepted one its own review.  Heads
are resolved, diffed against the repositories' high-water marks, files
selected and reviewed, annotated copies rendered, and the new rows of the
tables produced.  ``run_review`` writes them so that a run can be redone at
any point: its plan is stored before anything else and read again by a
retry, all rows go to the run's own folder, and the commit record comes last.
Runs may overlap: what depends on other runs (ids of repositories, marks) is
settled at the commit.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.functions import urls
from codesieve.operators import feedback as fb
from codesieve.operators import ids
from codesieve.operators import select as sel
from codesieve.operators import store
from codesieve.session import intermediates, materialize
from codesieve.sources import snapshots as snap

ACCEPTED, REJECTED = "accepted", "rejected"


def plan_runs(repositories: DataFrame, refs: DataFrame, modes: DataFrame | None = None, mode: str | None = None,
              branch: str = rules.DEFAULT_BRANCH, default_mode: str = rules.DEFAULT_MODE) -> DataFrame:
    """(repo_url, repository_id, base_snapshot, head_snapshot, mode) for repositories with a resolvable head.

    The base snapshot is the repository's ``last_reviewed_commit``; it is null
    on a first run, which then sees no changes.  ``modes`` gives a mode per
    repository (``repo_url, mode``); otherwise ``mode`` applies to all.  An
    empty or missing mode means ``default_mode``.
    """
    heads = snap.resolve_head(refs, branch)
    runs = repositories.select(F.col("url").alias("repo_url"), F.col("id").alias("repository_id"),
                               F.col("last_reviewed_commit").alias("base_snapshot")) \
        .join(heads, "repo_url", "inner")
    if modes is not None:
        runs = runs.join(modes.select("repo_url", "mode"), "repo_url", "inner")
    else:
        runs = runs.withColumn("mode", F.lit(mode))
    return runs.withColumn("mode", sel.normalize_mode(F.col("mode"), default_mode))


def request_outcomes(requests: DataFrame, repositories: DataFrame, refs: DataFrame, start: int,
                     branch: str = rules.DEFAULT_BRANCH, default_mode: str = rules.DEFAULT_MODE) -> DataFrame:
    """P9 + E1: one row per request: accepted with its repository and snapshots, or rejected with a reason.

    requests: ``(request_id, repo_url, mode)``, ids unique; repositories holds every parsable URL asked for
    (after the upsert).  Several requests for one repository are several reviews, in request order: the
    first sees the changes since the mark, the later ones find it where the first left it, at the head.
    Review ids follow ``start`` in (repo_url, request_id) order.
    """
    heads = snap.resolve_head(refs, branch).select(F.col("repo_url").alias("_h"), "head_snapshot")
    known = repositories.select(F.col("url").alias("_u"), F.col("id").alias("repository_id"),
                                F.col("last_reviewed_commit").alias("_mark"))
    parsed = requests.select("request_id", "repo_url", sel.normalize_mode(F.col("mode"), default_mode).alias("mode"),
                             urls.parse_repo_url("repo_url").alias("_p"))
    j = (parsed.join(known, F.col("repo_url") == F.col("_u"), "left")
         .join(heads, F.col("repo_url") == F.col("_h"), "left"))
    reason = (F.when(F.col("repo_url").isNull() | (F.col("repo_url") == ""), F.lit("missing repo"))
              .when(F.col("_p.owner").isNull(), F.lit("invalid repository url"))
              .when(F.col("_u").isNull(), F.lit("unknown repository"))
              .when(F.col("head_snapshot").isNull(), F.lit("branch not found")))
    # the first accepted request of a repository, by partial aggregation (no window per repository)
    first = (j.where(reason.isNull()).groupBy(F.col("repo_url").alias("_f")).agg(F.min("request_id").alias("_first")))
    j = j.withColumn("reason", reason).join(first, F.col("repo_url") == F.col("_f"), "left")
    ok = F.col("reason").isNull()
    base = F.when(F.col("request_id") == F.col("_first"), F.col("_mark")).otherwise(F.col("head_snapshot"))
    cols = ["request_id", "repo_url", "mode"]
    accepted = j.where(ok).select(*cols, F.lit(ACCEPTED).alias("status"), "reason", "repository_id",
                                  base.alias("base_snapshot"), "head_snapshot")
    null = F.lit(None)
    rejected = j.where(~ok).select(*cols, F.lit(REJECTED).alias("status"), "reason", null.cast("bigint").alias("repository_id"),
                                   null.cast("string").alias("base_snapshot"), null.cast("string").alias("head_snapshot"),
                                   null.cast("bigint").alias("review_id"))
    return ids.dense_ids(accepted, ["repo_url", "request_id"], start, "review_id").unionByName(rejected)


@dataclass
class RunResult:
    feedback_rows: DataFrame      # new file_feedback rows
    reviews: DataFrame            # new review headers
    repositories: DataFrame       # repositories with an advanced mark (only those)
    annotated: DataFrame          # annotated copies of the reviewed files
    rejects: DataFrame            # selected files that could not be reviewed, with the reason
    summary: DataFrame            # one row per run


def review_corpus(files: DataFrame, runs: DataFrame, repositories: DataFrame, run_ts: dt.datetime, run: int = 1,
                  max_files: int | None = None, replies: DataFrame | None = None, hash_col: str | None = None,
                  keep_text: bool = False, smart_cap: int | None = rules.SMART_CAP,
                  recent_cap: int | None = rules.RECENT_FALLBACK_CAP, similar: float | None = None) -> RunResult:
    """S4 -> S3 -> P1..P7 -> T14/T20 -> K6 -> P8 -> K3 -> K4 -> K5 -> A1 for every run.

    ``runs``: ([request_id,] repo_url, repository_id, base_snapshot, head_snapshot, mode), small rows.
    The files are read twice: once for keys and hashes, of the runs' snapshots alone (content is not hashed with a
    stored ``hash_col``, nor for runs in mode full), and once for the content of the selected files; their reviews
    are written once and read by all that follows.  ``max_files``, ``smart_cap`` and ``recent_cap`` None are off;
    with ``similar`` an edited rename leaves no deleted path among the changes.
    ``keep_text`` also carries the files' text, for annotated copies, and their bytes where ``files`` has a ``raw`` column.
    """
    runs = materialize(runs, "runs")
    keyed = snap.run_keys(files, runs, hash_col=hash_col)
    changed = snap.changes_of(keyed, files, runs, similar)
    head = keyed.where("in_head").select("repo_url", "path")
    selected = materialize(sel.select_files(head, changed, runs=runs, max_files=max_files, smart_cap=smart_cap,
                                            recent_cap=recent_cap, touched=snap.touched_repositories(keyed),
                                            carry=["head_snapshot"]), "selected")
    # the bytes where the reader gives them (annotated copies then keep them), and its reasons against files
    raw = ["raw"] if keep_text and "raw" in files.columns else []
    reasons = ["reject_reason"] if "reject_reason" in files.columns else []
    ok, bad = sel.split_rejects(sel.fetch_content(selected, files, runs, ["content", *raw, *reasons]))
    keys = store.run_keys(runs)
    carry = ["content", *raw] if keep_text else []
    if replies is not None:
        by_file = ["repo_url", "path"]
        extra = [k for k in keys if k != "repo_url"]
        reviewed = fb.review_with_replies(ok, replies, by_file, carry=[*extra, "content", *raw]).drop(*[] if keep_text else ["content"])
    else:
        reviewed = fb.review_files(ok, keys=[*keys, "repo_url"] if keys != ["repo_url"] else keys, carry=carry)
    reviewed = materialize(reviewed, "reviewed")
    start = ids.first_id(run)
    headers = store.review_headers(runs, run_ts, start)
    if "review_id" not in runs.columns:
        headers = materialize(headers, "headers")  # one row per run, numbered just now
    new_feedback = store.feedback_rows(reviewed, headers, run_ts, start)
    advanced = store.advance_watermark(repositories, runs, run_ts, only_changed=True)
    annotated = fb.annotate_files(reviewed).drop("content", "raw") if keep_text else reviewed
    rejects = bad.select(*[k for k in keys if k != "repo_url"], "repo_url", "path", F.col("reject_reason").alias("reason"))
    summary = store.review_summary(headers, new_feedback)
    return RunResult(new_feedback, headers, advanced, annotated, rejects, summary)


def numbered_requests(requests: DataFrame) -> DataFrame:
    """requests with ``request_id`` = 1, 2, ... where they have none, in (repo_url, requested_at, mode) order."""
    if "request_id" in requests.columns:
        return requests
    order = [c for c in ("requested_at", "repo_url", "mode") if c in requests.columns]  # ties are alike
    return ids.dense_ids(requests, order, 0, "request_id")


def run_review(tables, files: DataFrame, refs: DataFrame, requests: DataFrame, run_ts: dt.datetime, run_id: str,
               max_files: int | None = None, branch: str = rules.DEFAULT_BRANCH,
               replies: DataFrame | None = None, annotated_path: str | None = None,
               default_mode: str = rules.DEFAULT_MODE, hash_col: str | None = None,
               smart_cap: int | None = rules.SMART_CAP, recent_cap: int | None = rules.RECENT_FALLBACK_CAP,
               similar: float | None = None) -> DataFrame:
    """Answer a batch of requests against a :class:`~codesieve.sources.tables.TableStore`; returns the run summary.

    ``requests`` holds ``(repo_url, mode)`` and may hold ``request_id``.  ``run_id`` names the batch: calling
    again with it redoes or, once committed, only reads it.  The plan (outcomes of all requests, with base and
    head) and new repositories are written first; a retry reads them, so it does the same work whatever has
    been written since.  Annotated copies go to ``annotated_path/run=<n>``.  Intermediates go at the run's end; the
    summary is read from what was written.
    """
    run = tables.begin(run_id)
    if not tables.committed(run):
        with intermediates(tables.spark, f"{tables.root}/run={run}"):
            if not tables.written("outcomes", run):
                _store_plan(tables, run, requests, refs, run_ts, branch, default_mode)
            plan, planned = tables.read_run("outcomes", run), tables.read_run("planned_repositories", run)
            runs = plan.where(F.col("status") == ACCEPTED).drop("status", "reason")
            result = review_corpus(files, runs, planned, run_ts, run, max_files=max_files, replies=replies,
                                   hash_col=hash_col, keep_text=annotated_path is not None, smart_cap=smart_cap,
                                   recent_cap=recent_cap, similar=similar)
            if annotated_path:
                (result.annotated.write.mode("overwrite").partitionBy("repo_url")
                 .parquet(f"{annotated_path.rstrip('/')}/run={run}"))
            tables.write("file_feedback", result.feedback_rows, run)
            tables.write("file_rejects", result.rejects, run)
            tables.commit_checked(run, run_id, lambda: settle(tables, run, result.reviews, planned, result.repositories))
    return run_summary(tables, run)


def settle(tables, run: int, reviews: DataFrame, planned: DataFrame, advanced: DataFrame) -> None:
    """Write the reviews and repositories of a run as they fit the runs committed so far (K2, K5).

    A URL that another run has committed since this one was planned has that run's repository: the reviews refer to
    it, and this run's own row goes.  Of the repositories known to others only the advanced ones are written, so a
    mark set meanwhile is never put back by a run that did not review the repository.
    """
    known = tables.read("repositories").select(F.col("url").alias("_url"), F.col("id").alias("_id"), F.col("created_at").alias("_at"))
    # repositories of this run alone; read by both tables
    found = materialize(planned.join(known, F.col("url") == F.col("_url"), "left")
                        .select(*store.REPO_COLS, "_id", "_at"), "settled")
    ids_of = found.where(F.col("_id") != F.col("id")).select(F.col("id").alias("repository_id"), "_id")
    tables.write("reviews", reviews.join(ids_of, "repository_id", "left")
                 .withColumn("repository_id", F.coalesce("_id", "repository_id")), run)
    moved = (advanced.join(found.select("url", "_id", "_at"), "url")
             .withColumn("id", F.coalesce("_id", "id")).withColumn("created_at", F.coalesce("_at", "created_at")))
    fresh = found.where(F.col("_id").isNull()).join(advanced.select("url"), "url", "left_anti")
    tables.write("repositories", moved.select(*store.REPO_COLS).unionByName(fresh.select(*store.REPO_COLS)), run)


def _store_plan(tables, run: int, requests: DataFrame, refs: DataFrame, run_ts: dt.datetime, branch: str,
                default_mode: str) -> None:
    """Write the repositories asked for, new ones included, and then the outcome of every request."""
    start = ids.first_id(run)
    asked = materialize(numbered_requests(requests), "requests")
    wanted = asked.select(F.col("repo_url").alias("url"))
    repos = tables.read("repositories")
    new = store.new_repositories(repos, wanted, run_ts, start)
    tables.write("planned_repositories", repos.join(wanted.distinct(), "url", "left_semi").unionByName(new), run)
    tables.write("outcomes", request_outcomes(asked, tables.read_run("planned_repositories", run), refs, start, branch,
                                              default_mode), run)


def run_summary(tables, run: int) -> DataFrame:
    """A1 of a run, from its stored reviews and feedback; its plan has the repository and mode of each review."""
    plan = tables.read_run("outcomes", run).select(F.col("review_id").alias("id"), "repo_url", "mode")
    return store.review_summary(tables.read_run("reviews", run).join(plan, "id"), tables.read_run("file_feedback", run))
