"""Registered queries for scans, snapshots, refs and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions import text as tx
from codesieve.operators import select as sel
from codesieve.plans import corpus
from codesieve.plans import oracle as sq
from codesieve.plans.registry import FILE_KEYS, oracle_query, spark_query
from codesieve.plans.fixtures import Fixtures, duckdb_with
from codesieve.session import materialize, ship_package
from codesieve.sources import snapshots as snap

CAP_N = 7


def fixture_runs(fx: Fixtures, mode: str | None = None, modes: DataFrame | None = None) -> DataFrame:
    return corpus.plan_runs(fx.view("run_repositories_v"), fx.view("run_refs_v"), modes=modes, mode=mode)


def runs_sql(mode: str | None) -> str:
    mode_sql = "NULL" if mode is None else sq.q(mode)
    return sq.runs(f"lower(coalesce(nullif({mode_sql}, ''), 'full'))")


def with_runs(body: str, mode: str | None, extra_views: list[str] | None = None) -> str:
    """DuckDB statement: fixture views, then a ``runs`` CTE, then body."""
    inner = f"SELECT * FROM (WITH runs AS ({runs_sql(mode)}) {body}) z"
    return duckdb_with(inner, ["run_repositories_v", "run_refs_v", "snapshots_v"] + (extra_views or []))


@spark_query("scan_code_files")
def scan_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return snap.code_files(fx.view("files_v")).select(*FILE_KEYS, "path")


@oracle_query("scan_code_files")
def scan_code_files_sql() -> str:
    return duckdb_with(f"SELECT {', '.join(FILE_KEYS)}, path FROM files_v WHERE {sq.code_file('path')}", ["files_v"])


@spark_query("normalize_text")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return snap.normalize_text(fx.view("files_v")).select(*FILE_KEYS, "path", "content")


@oracle_query("normalize_text")
def normalize_text_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS content "
            f"FROM files_v")
    return duckdb_with(body, ["files_v"])


@spark_query("resolve_head")
def resolve_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return snap.resolve_head(fx.view("refs_v"))


@oracle_query("resolve_head")
def resolve_head_sql() -> str:
    return duckdb_with(sq.resolve_head("refs_v"), ["refs_v"])


@spark_query("snapshot_diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return snap.snapshot_diff(fx.view("base_v"), fx.view("files_v"))


@oracle_query("snapshot_diff")
def snapshot_diff_sql() -> str:
    body = sq.diff("SELECT repo_url, path, content FROM base_v", "SELECT repo_url, path, content FROM files_v")
    return duckdb_with(f"SELECT * FROM ({body}) d", ["files_v", "base_v"])


@spark_query("renamed_files")
def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    pairs = snap.renamed_files(fx.view("moved_base_v"), fx.view("moved_head_v"))
    return pairs.select("repo_url", "old_path", "path", F.round("score", 6).alias("score"))


@oracle_query("renamed_files")
def renamed_files_sql() -> str:
    return duckdb_with(f"SELECT repo_url, old_path, path, round(score, 6) AS score FROM ({sq.renames('moved_base_v', 'moved_head_v')}) r",
                       ["moved_base_v", "moved_head_v"])


@spark_query("changed_files_similar")
def changed_files_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 as names only: an edited rename is its new path."""
    fx = Fixtures(spark, sf_dir)
    return snap.snapshot_diff(fx.view("moved_base_v"), fx.view("moved_head_v"), similar=0.5)


@oracle_query("changed_files_similar")
def changed_files_similar_sql() -> str:
    b, h = "moved_base_v", "moved_head_v"
    body = (f"WITH renamed AS ({sq.renames(b, h)}) "
            f"SELECT coalesce(h.repo_url, b.repo_url) AS repo_url, coalesce(h.path, b.path) AS path, "
            f"CASE WHEN b.path IS NULL THEN 'A' WHEN h.path IS NULL THEN 'D' ELSE 'M' END AS status "
            f"FROM {b} b FULL JOIN {h} h ON b.repo_url = h.repo_url AND b.path = h.path "
            f"WHERE b.content IS DISTINCT FROM h.content AND NOT (h.path IS NULL AND EXISTS (SELECT 1 FROM renamed r "
            f"WHERE r.repo_url = b.repo_url AND r.old_path = b.path))")
    return duckdb_with(f"SELECT * FROM ({body}) d", [b, h])


@spark_query("changed_files")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return snap.changed_files(fx.view("snapshots_v"), fixture_runs(fx, "recent"))


@oracle_query("changed_files")
def changed_files_sql() -> str:
    return with_runs(f"SELECT * FROM ({sq.changed('runs')}) c", "recent")


def _selected(spark: SparkSession, sf_dir: str, mode: str, **caps) -> tuple[DataFrame, DataFrame, DataFrame]:
    fx = Fixtures(spark, sf_dir)
    files = fx.view("snapshots_v")
    runs = materialize(fixture_runs(fx, mode), "runs")
    keyed = snap.run_keys(files, runs)
    changed = snap.changes_of(keyed, files, runs)
    head = keyed.where("in_head").select("repo_url", "path")
    return sel.select_files(head, changed, runs=runs, touched=snap.touched_repositories(keyed), **caps), files, runs


def _selected_sql(mode: str, **caps) -> str:
    return (f"SELECT * FROM ({sq.select_files('runs', '(' + sq.changed('runs') + ')', '(' + sq.head_files('runs') + ')', **caps)}) s")


# the caps of modes smart and recent are their feature; the last of these queries is the overall cap's
for _name, _mode, _caps in [("select_full", "full", {}), ("select_recent", "Recent", {}), ("select_smart", "smart", {}),
                            ("select_fallback", "other", {}), ("select_capped", "other", {"max_files": CAP_N})]:
    def _q(spark: SparkSession, sf_dir: str, _m: str = _mode, _c: dict = _caps) -> DataFrame:
        return _selected(spark, sf_dir, _m, **_c)[0]

    def _o(_m: str = _mode, _c: dict = _caps) -> str:
        return with_runs(_selected_sql(_m, **_c), _m)

    spark_query(_name)(_q)
    oracle_query(_name)(_o)


@spark_query("cap_files")
def cap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    code = snap.code_files(fx.view("files_v")).select("repo_url", "path")
    return sel.cap_files(code, CAP_N)


@oracle_query("cap_files")
def cap_files_sql() -> str:
    body = (f"SELECT * FROM (SELECT repo_url, path, (row_number() OVER (PARTITION BY repo_url ORDER BY path))::BIGINT "
            f"AS rank FROM files_v WHERE {sq.code_file('path')}) c WHERE rank <= {CAP_N}")
    return duckdb_with(body, ["files_v"])


@spark_query("existing_only")
def existing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, _, _ = _selected(spark, sf_dir, "other")
    head = Fixtures(spark, sf_dir).view("files_v")
    return sel.existing_only(materialize(selected, "selected"), head).select(
        "repo_url", "path", "from_changes", "mode", F.length("content").cast("bigint").alias("chars"))


@spark_query("fetch_content")
def fetch_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, files, runs = _selected(spark, sf_dir, "other")
    present = sel.fetch_content(materialize(selected, "selected"), files, runs)
    return present.select("repo_url", "path", "from_changes", "mode", F.length("content").cast("bigint").alias("chars"))


def _present_sql() -> str:
    body = (f"SELECT s.repo_url, s.path, s.from_changes, s.mode, length(h.content)::BIGINT AS chars "
            f"FROM ({_selected_sql('other')}) s JOIN ({sq.head_files('runs')}) h "
            f"ON s.repo_url = h.repo_url AND s.path = h.path")
    return with_runs(body, "other")


oracle_query("existing_only")(_present_sql)
oracle_query("fetch_content")(_present_sql)


@spark_query("split_rejects")
def split_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # head paths paired with their base version: files added since the base have no readable content.
    # Only whether there is content is joined, never the content
    fx = Fixtures(spark, sf_dir)
    head = fx.view("files_v").select("repo_url", "path")
    base = fx.view("base_v").select("repo_url", "path", F.col("content").isNotNull().alias("readable"))
    ok, bad = sel.split_rejects(head.join(base, ["repo_url", "path"], "left"), "readable IS NULL OR NOT readable")
    return ok.select("repo_url", "path", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason")) \
        .unionByName(bad.select("repo_url", "path", F.lit("rejected").alias("status"),
                                F.col("reject_reason").alias("reason")))


@oracle_query("split_rejects")
def split_rejects_sql() -> str:
    body = ("SELECT h.repo_url, h.path, CASE WHEN b.content IS NULL THEN 'rejected' "
            "ELSE 'ok' END AS status, CASE WHEN b.content IS NULL THEN 'unreadable content' END AS reason "
            "FROM files_v h LEFT JOIN base_v b ON h.repo_url = b.repo_url AND h.path = b.path")
    return duckdb_with(body, ["files_v", "base_v"])


@spark_query("decode_text")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 for bytes: every document's bytes with a lone 0xFF before and a cut character behind them."""
    ship_package(spark)
    docs = Fixtures(spark, sf_dir).table("documents")
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"),
                   F.unhex(F.lit("0DE282")))
    return docs.select("doc_id", snap.decode_text(raw).alias("content"))


@oracle_query("decode_text")
def decode_text_sql() -> str:
    return "SELECT doc_id, text || chr(10) AS content FROM documents"


@spark_query("line_count_normalized")
def line_count_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    # S2 + T9: universal newlines before counting lines
    fx = Fixtures(spark, sf_dir)
    files = snap.normalize_text(fx.view("files_v"))
    return files.select(*FILE_KEYS, "path", tx.line_count("content").alias("lines"))


@oracle_query("line_count_normalized")
def line_count_normalized_sql() -> str:
    c = "regexp_replace(content, '\\r\\n?', chr(10), 'g')"
    return duckdb_with(f"SELECT {', '.join(FILE_KEYS)}, path, {sq.line_count(c)} AS lines FROM files_v", ["files_v"])
