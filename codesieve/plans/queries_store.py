"""Registered queries for the review tables and the end-to-end run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions import text as tx
from codesieve.operators import feedback as fb
from codesieve.operators import select as sel
from codesieve.operators import store
from codesieve.plans import corpus
from codesieve.plans import oracle as sq
from codesieve.plans.registry import FILE_KEYS, oracle_query, spark_query
from codesieve.plans.fixtures import Fixtures, duckdb_with
from codesieve.plans.queries_select import fixture_runs
from codesieve.session import materialize, shared_path, ship_package
from codesieve.sources import buckets
from codesieve.sources import snapshots as snap
from codesieve.sources.tables import TableStore
from codesieve.sources.tree import CodeTreeDataSource
from codesieve.operators import ids

RUN_TS = dt.datetime(2025, 1, 1, 0, 0, 0)
RUN = 1
START = ids.first_id(RUN)
TS_SQL = "TIMESTAMP '2025-01-01 00:00:00'"
REPO = ", ".join(store.REPO_COLS)
REVIEW = ", ".join(store.REVIEW_COLS)
FEEDBACK = ", ".join(store.FEEDBACK_COLS)
RUN_VIEWS = ["run_repositories_v", "run_refs_v", "snapshots_v", "runs_v", "reviews_v", "feedback_v"]


def _runs(fx: Fixtures) -> DataFrame:
    return fixture_runs(fx, modes=fx.view("runs_v"))


def _with(body: str, views: list[str]) -> str:
    """Fixture views, then ``runs`` and ``hdr`` CTEs, then body."""
    inner = f"SELECT * FROM (WITH runs AS ({sq.runs_with_modes()}), hdr AS ({sq.headers('runs', TS_SQL, START)}) {body}) z"
    return duckdb_with(inner, RUN_VIEWS + views)


# --- K2 -------------------------------------------------------------------

@spark_query("upsert_repositories")
def upsert_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    incoming = fx.view("requests_v").select(F.col("repo").alias("url")).unionByName(fx.view("urls_v").select("url"))
    return store.upsert_repositories(fx.view("repositories_v"), incoming, RUN_TS, START)


@oracle_query("upsert_repositories")
def upsert_repositories_sql() -> str:
    inc = ("SELECT DISTINCT url FROM (SELECT repo AS url FROM requests_v UNION ALL SELECT url FROM urls_v) i "
           "WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM repositories_v e WHERE e.url = i.url)")
    new = f"SELECT * FROM ({sq.parse_urls(inc)}) n WHERE valid"
    body = (f"SELECT {REPO} FROM repositories_v UNION ALL "
            f"SELECT {START} + row_number() OVER (ORDER BY url) AS id, owner, name, url, "
            f"NULL AS last_reviewed_commit, {TS_SQL} AS created_at, {TS_SQL} AS updated_at FROM ({new}) nv")
    return duckdb_with(body, ["requests_v", "urls_v", "repositories_v"])


# --- P8 / K3 / K5 -----------------------------------------------------------

@spark_query("review_headers")
def review_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    h = store.review_headers(_runs(fx), RUN_TS, START)
    return h.select("id", "repo_url", "repository_id", "mode", "commit_sha", "branch", "pr_url", "pr_title",
                    "commit_message", "created_at")


@oracle_query("review_headers")
def review_headers_sql() -> str:
    return _with("SELECT id::BIGINT AS id, repo_url, repository_id, mode, commit_sha, branch, pr_url, pr_title, "
                 "commit_message, created_at FROM hdr", [])


@spark_query("append_reviews")
def append_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    h = store.review_headers(_runs(fx), RUN_TS, START)
    return store.append_rows(fx.view("reviews_v"), h, store.REVIEW_COLS)


@oracle_query("append_reviews")
def append_reviews_sql() -> str:
    return _with(f"SELECT {REVIEW} FROM reviews_v UNION ALL SELECT id::BIGINT, repository_id, commit_sha, branch, "
                 f"pr_url, created_at FROM hdr", [])


@spark_query("advance_watermark")
def advance_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return store.advance_watermark(fx.view("run_repositories_v"), _runs(fx), RUN_TS)


@oracle_query("advance_watermark")
def advance_watermark_sql() -> str:
    return _with(f"SELECT r.id, r.owner, r.name, r.url, CASE WHEN u.head_snapshot IS NOT NULL THEN u.head_snapshot "
                 f"ELSE r.last_reviewed_commit END AS last_reviewed_commit, r.created_at, "
                 f"CASE WHEN u.head_snapshot IS NOT NULL THEN {TS_SQL} ELSE r.updated_at END AS updated_at "
                 f"FROM run_repositories_v r LEFT JOIN runs u ON u.repo_url = r.url", [])


# --- E1 and what it feeds (K4, A1, K6) ---------------------------------------

def _corpus(spark: SparkSession, sf_dir: str) -> corpus.RunResult:
    fx = Fixtures(spark, sf_dir)
    return corpus.review_corpus(fx.view("snapshots_v"), _runs(fx), fx.view("run_repositories_v"), RUN_TS, RUN)


def _reviewed_sql() -> str:
    changed = "(" + sq.changed("runs") + ")"
    head = "(" + sq.head_files("runs") + ")"
    selected = sq.select_files("runs", changed, head)
    present = (f"SELECT s.repo_url, s.path, h.content FROM ({selected}) s JOIN {head} h "
               f"ON s.repo_url = h.repo_url AND s.path = h.path WHERE h.content IS NOT NULL")
    return sq.review_files(present, ["repo_url"])


def _new_feedback_sql() -> str:
    rows = (f"SELECT h.id AS review_id, r.path AS file_path, r.classification, r.feedback, {TS_SQL} AS created_at "
            f"FROM ({_reviewed_sql()}) r JOIN hdr h ON h.repo_url = r.repo_url")
    return (f"SELECT ({START} + row_number() OVER (ORDER BY review_id, file_path))::BIGINT "
            f"AS id, review_id::BIGINT AS review_id, file_path, classification, feedback, created_at FROM ({rows}) fr")


@spark_query("review_corpus")
def review_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).feedback_rows


@oracle_query("review_corpus")
def review_corpus_sql() -> str:
    return _with(_new_feedback_sql(), [])


@spark_query("append_feedback")
def append_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return store.append_rows(fx.view("feedback_v"), _corpus(spark, sf_dir).feedback_rows, store.FEEDBACK_COLS)


@oracle_query("append_feedback")
def append_feedback_sql() -> str:
    return _with(f"SELECT {FEEDBACK} FROM feedback_v UNION ALL SELECT * FROM ({_new_feedback_sql()}) nf", [])


@spark_query("review_summary")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).summary


@oracle_query("review_summary")
def review_summary_sql() -> str:
    body = (f"SELECT h.repo_url AS repository, h.commit_sha AS commit, coalesce(c.n, 0)::BIGINT AS files_reviewed, "
            f"h.pr_url, h.id::BIGINT AS review_id, h.mode FROM hdr h LEFT JOIN (SELECT review_id, count(*) AS n "
            f"FROM ({_new_feedback_sql()}) nf GROUP BY review_id) c ON c.review_id = h.id")
    return _with(body, [])


@spark_query("annotate_files")
def annotate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    files = fx.files()
    reviewed = fb.review_files(files, keys=FILE_KEYS, carry=["content"])
    return fb.annotate_files(reviewed).select(*FILE_KEYS, "path", "annotated")


@oracle_query("annotate_files")
def annotate_files_sql() -> str:
    rv = sq.review_files("SELECT * FROM files_v", FILE_KEYS)
    sep = ("chr(10) || CASE WHEN ends_with(f.path, '.py') THEN '#' ELSE '//' END || ' --- Auto Review (' "
           "|| r.classification || ') ---' || chr(10)")
    body = (f"SELECT f.repo_url, f.snapshot_id, f.doc_id, f.path, f.content || {sep} || CASE WHEN "
            f"ends_with(r.feedback, chr(10)) THEN r.feedback ELSE r.feedback || chr(10) END AS annotated "
            f"FROM files_v f JOIN ({rv}) r ON f.repo_url = r.repo_url AND f.snapshot_id = r.snapshot_id "
            f"AND f.doc_id = r.doc_id AND f.path = r.path")
    return duckdb_with(body, ["files_v"])


def _raw_files(fx: Fixtures) -> DataFrame:
    """files_v as a reader of bytes gives it: a lone 0xFF before each text, a carriage return and a cut character behind it."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("content", "UTF-8"), F.unhex(F.lit("0DE282")))
    files = fx.view("files_v").select("repo_url", "snapshot_id", "path", raw.alias("raw"))
    return files.withColumn("content", snap.decode_text("raw"))


@spark_query("annotate_bytes")
def annotate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, K6 through a whole run: the bytes of every reviewed file are kept, the note follows them."""
    ship_package(spark)
    fx = Fixtures(spark, sf_dir)
    runs = fixture_runs(fx, mode="full")
    result = corpus.review_corpus(_raw_files(fx), runs, fx.view("run_repositories_v"), RUN_TS, RUN, keep_text=True)
    return result.annotated.select("repo_url", "path", F.octet_length("annotated_raw").cast("bigint").alias("bytes"),
                                   F.sha2("annotated_raw", 256).alias("sha256"))


def _noted_sql(raw: str) -> str:
    """(repo_url, path, annotated): the raw bytes of every code file with the note of its review behind them."""
    text = "regexp_replace(content, '\\r\\n?', chr(10), 'g') || chr(10)"
    files = f"SELECT repo_url, path, {text} AS content FROM files_v WHERE {sq.code_file('path')}"
    rv = sq.review_files(files, ["repo_url"])
    note = ("chr(10) || CASE WHEN ends_with(f.path, '.py') THEN '#' ELSE '//' END || ' --- Auto Review (' || r.classification "
            "|| ') ---' || chr(10) || r.feedback || CASE WHEN ends_with(r.feedback, chr(10)) THEN '' ELSE chr(10) END")
    return f"SELECT f.repo_url, f.path, {raw} || encode({note}) AS annotated FROM files_v f JOIN ({rv}) r ON f.repo_url = r.repo_url AND f.path = r.path"


RAW_SQL = "'\\xFF'::BLOB || encode(f.content) || '\\x0D\\xE2\\x82'::BLOB"


@oracle_query("annotate_bytes")
def annotate_bytes_sql() -> str:
    return duckdb_with(f"SELECT repo_url, path, octet_length(annotated)::BIGINT AS bytes, sha256(annotated) AS sha256 FROM ({_noted_sql(RAW_SQL)}) a",
                       ["files_v"])


@spark_query("patched_tree")
def patched_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, S2 through real files: all files written as a tree, read, reviewed, the patched copies written and read again."""
    ship_package(spark)
    spark.dataSource.register(CodeTreeDataSource)
    fx = Fixtures(spark, sf_dir)
    before, after = shared_path(spark, "tree"), shared_path(spark, "patched")
    code = snap.code_files(_raw_files(fx)).select("repo_url", "path", "raw")
    prefix = "https://github.com/"
    code.write.format("code_tree").option("url_prefix", prefix).mode("append").save(before)
    read = spark.read.format("code_tree").option("url_prefix", prefix).option("with_raw", "true")
    ok, _ = sel.split_rejects(read.load(before))
    noted = fb.annotate_files(fb.review_files(ok, keys=["repo_url"], carry=["content", "raw"]))
    (noted.select("repo_url", "path", F.col("annotated_raw").alias("raw")).write.format("code_tree")
     .option("url_prefix", prefix).mode("append").save(after))
    return read.load(after).select("repo_url", "path", F.col("size").alias("bytes"), F.sha2("raw", 256).alias("sha256"), "reject_reason")


@oracle_query("patched_tree")
def patched_tree_sql() -> str:
    return duckdb_with(f"SELECT repo_url, path, octet_length(annotated)::BIGINT AS bytes, sha256(annotated) AS sha256, NULL::VARCHAR AS reject_reason "
                       f"FROM ({_noted_sql(RAW_SQL)}) a", ["files_v"])


# --- J1 / J2 / J3 / O1 / P11 / T17 / P9 ---------------------------------------

def _listing_sql() -> str:
    return ("SELECT v.id, p.url AS repository, p.owner, p.name, v.commit_sha AS commit, v.branch, v.pr_url, "
            "v.created_at FROM reviews_v v JOIN repositories_v p ON v.repository_id = p.id")


@spark_query("list_reviews")
def list_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return store.list_reviews(fx.view("reviews_v"), fx.view("repositories_v"), limit=20)


@oracle_query("list_reviews")
def list_reviews_sql() -> str:
    body = (f"SELECT id, repository, owner, name, commit, branch, pr_url, {sq.iso('created_at')} AS created_at "
            f"FROM ({_listing_sql()}) l ORDER BY l.created_at DESC, id DESC LIMIT 20")
    return duckdb_with(body, ["reviews_v", "repositories_v"])


@spark_query("list_reviews_for_repo")
def list_reviews_for_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 as the service answers it: the newest reviews of the repository of customer 1."""
    fx = Fixtures(spark, sf_dir)
    repos = fx.view("repositories_v")
    url = repos.where("id = 1").first()["url"]
    return store.list_reviews(fx.view("reviews_v"), repos, repo=url, limit=20)


@oracle_query("list_reviews_for_repo")
def list_reviews_for_repo_sql() -> str:
    body = (f"SELECT id, repository, owner, name, commit, branch, pr_url, {sq.iso('created_at')} AS created_at "
            f"FROM ({_listing_sql()}) l WHERE repository = (SELECT url FROM repositories_v WHERE id = 1) "
            f"ORDER BY l.created_at DESC, id DESC LIMIT 20")
    return duckdb_with(body, ["reviews_v", "repositories_v"])


@spark_query("list_reviews_per_repo")
def list_reviews_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return store.list_reviews_per_repo(fx.view("reviews_v"), fx.view("repositories_v"), limit=20)


@oracle_query("list_reviews_per_repo")
def list_reviews_per_repo_sql() -> str:
    body = (f"SELECT id, repository, owner, name, commit, branch, pr_url, {sq.iso('created_at')} AS created_at, "
            f"position FROM (SELECT *, (row_number() OVER (PARTITION BY repository ORDER BY created_at DESC, id DESC))"
            f"::BIGINT AS position FROM ({_listing_sql()}) l) x WHERE position <= 20")
    return duckdb_with(body, ["reviews_v", "repositories_v"])


@spark_query("review_with_repo")
def review_with_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return store.review_with_repo(fx.view("reviews_v"), fx.view("repositories_v"))


def _with_repo_sql() -> str:
    return (f"SELECT v.id, p.url AS repository, v.commit_sha AS commit, v.branch, v.pr_url, "
            f"{sq.iso('v.created_at')} AS created_at FROM reviews_v v LEFT JOIN repositories_v p "
            f"ON v.repository_id = p.id")


@oracle_query("review_with_repo")
def review_with_repo_sql() -> str:
    return duckdb_with(_with_repo_sql(), ["reviews_v", "repositories_v"])


CHUNK = 3


def _flat(nested: DataFrame) -> DataFrame:
    """Nested reviews flattened for hashing: files as text lines in (file_path, id) order."""
    lines = F.transform("files", lambda f: F.concat_ws(
        "|", f["file_path"], f["id"].cast("string"), f["classification"], f["feedback"], f["created_at"]))
    return nested.select("id", "repository", "commit", "branch", "pr_url", "created_at", "chunk",
                         F.size("files").cast("bigint").alias("n_files"),
                         F.array_join(lines, "\n").alias("files_text"))


def _nested_sql(chunk: int, where: str = "") -> str:
    line = (f"file_path || '|' || CAST(id AS VARCHAR) || '|' || classification || '|' || feedback || '|' || "
            f"{sq.iso('created_at')}")
    placed = (f"SELECT *, ((row_number() OVER (PARTITION BY review_id ORDER BY file_path, id, classification, feedback, created_at) - 1) // {chunk})::BIGINT "
              f"AS chunk FROM feedback_v")
    files = (f"SELECT review_id, chunk, count(*) AS n, string_agg({line}, chr(10) ORDER BY file_path, id, classification, feedback, created_at) AS t "
             f"FROM ({placed}) p GROUP BY review_id, chunk")
    body = (f"SELECT w.*, coalesce(f.chunk, 0)::BIGINT AS chunk, coalesce(f.n, 0)::BIGINT AS n_files, "
            f"coalesce(f.t, '') AS files_text "
            f"FROM ({_with_repo_sql()}) w LEFT JOIN ({files}) f ON f.review_id = w.id {where}")
    return duckdb_with(body, ["reviews_v", "repositories_v", "feedback_v"])


@spark_query("get_review")
def get_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return _flat(store.get_review(fx.view("reviews_v"), fx.view("repositories_v"), fx.view("feedback_v"), chunk_files=CHUNK))


@oracle_query("get_review")
def get_review_sql() -> str:
    return _nested_sql(CHUNK)


@spark_query("get_review_bucketed")
def get_review_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + A2 over feedback laid out in buckets by (review, chunk)."""
    fx = Fixtures(spark, sf_dir)
    path = shared_path(spark, "feedback")
    table = buckets.lay_out_feedback(fx.view("feedback_v"), f"feedback_{path[-32:]}", path, chunk_files=CHUNK,
                                     buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _flat(buckets.nested_reviews(fx.view("reviews_v"), fx.view("repositories_v"), table))


@oracle_query("get_review_bucketed")
def get_review_bucketed_sql() -> str:
    return _nested_sql(CHUNK)


@spark_query("review_by_id")
def review_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the review with the largest id, and the id above it, which is absent and gives no row."""
    fx = Fixtures(spark, sf_dir)
    reviews, repos, feedback = fx.view("reviews_v"), fx.view("repositories_v"), fx.view("feedback_v")
    last = reviews.agg(F.max("id")).first()[0]
    return _flat(store.get_review(reviews, repos, feedback, last).unionByName(
        store.get_review(reviews, repos, feedback, last + 1)))


@oracle_query("review_by_id")
def review_by_id_sql() -> str:
    return _nested_sql(1000, "WHERE w.id = (SELECT max(id) FROM reviews_v)")


@spark_query("review_files_flat")
def review_files_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return store.review_files_of(fx.view("reviews_v"), fx.view("repositories_v"), fx.view("feedback_v"))


@oracle_query("review_files_flat")
def review_files_flat_sql() -> str:
    body = (f"SELECT w.*, f.file_path, f.id AS feedback_id, f.classification, f.feedback, "
            f"{sq.iso('f.created_at')} AS feedback_created_at FROM ({_with_repo_sql()}) w "
            f"LEFT JOIN feedback_v f ON f.review_id = w.id")
    return duckdb_with(body, ["reviews_v", "repositories_v", "feedback_v"])


# --- requests and the stored tables (P9, K1, K3-K5, S5) -----------------------

@spark_query("run_outcomes")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome for every request of a batch: rows in = rows out."""
    fx = Fixtures(spark, sf_dir)
    asked, repos = fx.view("asked_v"), fx.view("run_repositories_v")
    new = store.new_repositories(repos, asked.select(F.col("repo_url").alias("url")), RUN_TS, START)
    return corpus.request_outcomes(asked, materialize(repos.unionByName(new), "repositories"), fx.view("run_refs_v"), START)


@oracle_query("run_outcomes")
def run_outcomes_sql() -> str:
    # acme repositories are known; any other parsable address is new and has no head
    known = (f"SELECT a.*, p.valid, r.id AS rid, r.last_reviewed_commit AS mark, h.head_snapshot AS head FROM asked_v a "
             f"LEFT JOIN ({sq.parse_urls('SELECT DISTINCT repo_url FROM asked_v WHERE repo_url IS NOT NULL', 'repo_url')}) p "
             f"ON p.repo_url = a.repo_url LEFT JOIN run_repositories_v r ON r.url = a.repo_url "
             f"LEFT JOIN ({sq.resolve_head('run_refs_v')}) h ON h.repo_url = a.repo_url")
    why = ("CASE WHEN repo_url IS NULL OR repo_url = '' THEN 'missing repo' WHEN NOT valid THEN 'invalid repository url' "
           "WHEN head IS NULL THEN 'branch not found' END")
    good = f"SELECT *, {why} AS reason FROM ({known}) k"
    body = (f"SELECT request_id, repo_url, lower(coalesce(nullif(mode, ''), 'full')) AS mode, "
            f"CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, "
            f"CASE WHEN reason IS NULL THEN rid END AS repository_id, CASE WHEN reason IS NULL THEN CASE WHEN row_number() "
            f"OVER (PARTITION BY repo_url, reason IS NULL ORDER BY request_id) = 1 THEN mark ELSE head END END AS base_snapshot, "
            f"CASE WHEN reason IS NULL THEN head END AS head_snapshot, CASE WHEN reason IS NULL THEN {START} + row_number() "
            f"OVER (PARTITION BY reason IS NULL ORDER BY repo_url, request_id) END AS review_id FROM ({good}) g")
    return duckdb_with(body, ["asked_v", "run_repositories_v", "run_refs_v"])


@spark_query("store_round_trip")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3-K5, S5 through the real sink: three committed runs, one redone half-way and one never committed.

    The first run writes the repositories and all feedback; another advances the marks of every third repository;
    a run that began before it and commits after it those of every fifth; a last one writes everything again and is
    not committed.  Rows are read back through the store: the commits' order counts, not the runs'.
    """
    fx = Fixtures(spark, sf_dir)
    tables = TableStore(spark, shared_path(spark, "store"))
    repos, feedback, reviews = fx.view("repositories_v"), fx.view("feedback_v"), fx.view("reviews_v")
    first = tables.begin("load")
    tables.write("file_feedback", feedback.where("id % 2 = 0"), first)  # an attempt that broke off
    first = tables.begin("load")
    for name, rows in (("repositories", repos), ("file_feedback", feedback), ("reviews", reviews)):
        tables.write(name, rows, first)
    tables.commit(first, "load")
    late, second = tables.begin("late"), tables.begin("advance")
    for run, name, every, mark in ((second, "advance", 3, "head"), (late, "late", 5, "later")):
        runs = repos.where(F.col("id") % every == 0).select(F.col("url").alias("repo_url"), F.lit(mark).alias("head_snapshot"))
        tables.write("repositories", store.advance_watermark(repos, runs, RUN_TS, only_changed=True), run)
        tables.commit(run, name)
    third = tables.begin("lost")
    for name, rows in (("repositories", repos), ("file_feedback", feedback), ("reviews", reviews)):
        tables.write(name, rows, third)
    out = [tables.read("repositories").select(F.lit("repositories").alias("stored"), "id", F.col("last_reviewed_commit").alias("value")),
           tables.read("file_feedback").select(F.lit("file_feedback"), "id", "feedback"),
           tables.read("reviews").select(F.lit("reviews"), "id", "commit_sha")]
    return out[0].union(out[1]).union(out[2])


@oracle_query("store_round_trip")
def store_round_trip_sql() -> str:
    body = ("SELECT 'repositories' AS stored, id, CASE WHEN id % 5 = 0 THEN 'later' WHEN id % 3 = 0 THEN 'head' ELSE last_reviewed_commit END AS value "
            "FROM repositories_v UNION ALL SELECT 'file_feedback', id, feedback FROM feedback_v "
            "UNION ALL SELECT 'reviews', id, commit_sha FROM reviews_v")
    return duckdb_with(body, ["repositories_v", "feedback_v", "reviews_v"])


@spark_query("concurrent_runs")
def concurrent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K5 with two runs that plan before either commits: one repository per URL, all reviews listed under it.

    The first run reviews every repository asked for or listed; the second, planned on the same empty store, those
    whose URL has an odd length, and commits last.
    """
    fx = Fixtures(spark, sf_dir)
    tables = TableStore(spark, shared_path(spark, "store"))
    asked = fx.view("requests_v").select(F.col("repo").alias("url")).unionByName(fx.view("urls_v").select("url"))
    plans = []
    for name, wanted, head in (("one", asked, "h1"), ("two", asked.where(F.length("url") % 2 == 1), "h2")):
        run = tables.begin(name)
        tables.write("planned_repositories", store.new_repositories(tables.read("repositories"), wanted, RUN_TS, ids.first_id(run)), run)
        plans.append((run, name, head))
    for run, name, head in plans:
        planned = tables.read_run("planned_repositories", run)
        runs = planned.select(F.col("url").alias("repo_url"), F.col("id").alias("repository_id"), F.lit(head).alias("head_snapshot"),
                              F.lit("full").alias("mode"))
        headers = materialize(store.review_headers(runs, RUN_TS, ids.first_id(run)), "headers")
        moved = store.advance_watermark(planned, runs, RUN_TS, only_changed=True)
        tables.commit_checked(run, name, lambda: corpus.settle(tables, run, headers, planned, moved))
    listed = tables.read("reviews").alias("v").join(tables.read("repositories").alias("p"), F.col("v.repository_id") == F.col("p.id"))
    return listed.select(F.col("v.id").alias("review_id"), F.col("p.id").alias("repository_id"), F.col("p.url").alias("repository"),
                         F.col("v.commit_sha").alias("commit"), F.col("p.last_reviewed_commit").alias("mark"))


@oracle_query("concurrent_runs")
def concurrent_runs_sql() -> str:
    urls = ("SELECT DISTINCT url FROM (SELECT repo AS url FROM requests_v UNION ALL SELECT url FROM urls_v) i WHERE url IS NOT NULL")
    new = f"SELECT url, row_number() OVER (ORDER BY url) AS k FROM ({sq.parse_urls(urls)}) n WHERE valid"
    body = (f"WITH one AS ({new}), two AS (SELECT url, row_number() OVER (ORDER BY url) AS k FROM one WHERE length(url) % 2 = 1) "
            f"SELECT {ids.first_id(1)} + v.k AS review_id, {ids.first_id(1)} + one.k AS repository_id, one.url AS repository, v.commit, "
            f"CASE WHEN length(one.url) % 2 = 1 THEN 'h2' ELSE 'h1' END AS mark FROM one JOIN "
            f"(SELECT url, k, 'h1' AS commit FROM one UNION ALL SELECT url, k + {ids.first_id(2) - ids.first_id(1)}, 'h2' FROM two) v ON v.url = one.url")
    return duckdb_with(f"SELECT * FROM ({body}) c", ["requests_v", "urls_v"])


@spark_query("iso_timestamps")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return fx.view("feedback_v").select("id", tx.iso_timestamp("created_at").alias("created_at_iso"))


@oracle_query("iso_timestamps")
def iso_timestamps_sql() -> str:
    return duckdb_with(f"SELECT id, {sq.iso('created_at')} AS created_at_iso FROM feedback_v", ["feedback_v"])


@spark_query("validate_requests")
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return store.validate_requests(fx.view("requests_v"))


@oracle_query("validate_requests")
def validate_requests_sql() -> str:
    lim = "coalesce(page_limit, 20)"
    reason = (f"CASE WHEN repo IS NULL OR repo = '' THEN 'missing repo' WHEN {lim} < 1 OR {lim} > 100 "
              f"THEN 'limit out of range' END")
    body = (f"SELECT event_id, user_id, repo, mode, page_limit, lower(coalesce(nullif(mode, ''), 'full')) AS effective_mode, "
            f"{lim}::BIGINT AS effective_limit, ({reason}) IS NULL AS valid, {reason} AS reason FROM requests_v")
    return duckdb_with(body, ["requests_v"])
