"""Physical-plan properties that matter at scale."""

import datetime as dt
import re

from pyspark.sql import functions as F

from codesieve import schema
from codesieve.operators import feedback as fb
from codesieve.operators import select as sel
from codesieve.operators import store
from codesieve.operators.ids import dense_ids
from codesieve.plans import corpus
from codesieve.plans.fixtures import Fixtures
from codesieve.plans.queries_select import fixture_runs
from codesieve.session import materialize
from codesieve.sources import snapshots as snap
from tests.conftest import SF_SMALL


def plan_of(df, capsys, mode="simple"):
    capsys.readouterr()
    df.explain(mode)
    return capsys.readouterr().out


def test_cap_limits_rows_before_the_shuffle(spark, capsys):
    fx = Fixtures(spark, SF_SMALL)
    code = snap.code_files(fx.view("files_v")).select("repo_url", "path")
    p = plan_of(sel.cap_files(code, 7), capsys)
    partial = p.find("WindowGroupLimit")
    assert "Partial" in p and "Final" in p
    # the partial limit sits below (after, in the text) the exchange it feeds
    ex = p.find("Exchange hashpartitioning")
    assert 0 <= ex < p.rfind("Partial") and partial >= 0


def test_review_is_a_projection_with_a_broadcast_dimension(spark, capsys):
    fx = Fixtures(spark, SF_SMALL)
    p = plan_of(fb.review_files(fx.view("files_v"), keys=["repo_url", "doc_id"]), capsys)
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p
    assert "Exchange hashpartitioning" not in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p
    done = fb.review_files(fx.view("files_v"), keys=["doc_id"])
    done.collect()
    final = plan_of(done, capsys, "formatted")
    assert "isFinalPlan=true" in final
    section = final.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    # every projection and the join run inside whole-stage codegen (marked "*")
    ops = re.findall(r"(\*?) ?(Project|BroadcastHashJoin)[^\n]*\(\d+\)", section)
    assert ops and all(star == "*" for star, _ in ops), section


def test_scan_reads_only_needed_columns(spark, capsys):
    fx = Fixtures(spark, SF_SMALL)
    p = plan_of(snap.code_files(fx.view("files_v")).select("repo_url", "path"), capsys)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("text" not in s for s in schemas)


def test_listing_is_a_top_k(spark, capsys):
    fx = Fixtures(spark, SF_SMALL)
    p = plan_of(store.list_reviews(fx.view("reviews_v"), fx.view("repositories_v"), limit=20), capsys)
    assert "TakeOrderedAndProject" in p


def test_no_forced_hint_and_no_single_task(spark, capsys):
    """Data-dependent sides are left to the planner; nothing but per-partition sums goes to one task."""
    fx = Fixtures(spark, SF_SMALL)
    files = fx.view("snapshots_v")
    runs = materialize(fixture_runs(fx, "other"))
    changed = snap.changed_files(files, runs)
    s = materialize(sel.select_files(snap.head_keys(files, runs), changed, runs=runs))
    fetched = sel.fetch_content(s, files, runs)
    for df in (changed, fetched, fb.review_files(fetched, keys=["repo_url"])):
        p = plan_of(df, capsys, "extended")
        assert "SinglePartition" not in p and "strategy=broadcast" not in p
    # both small sides were written, so the planner knows that they are small
    assert plan_of(fetched.select(F.length("content")), capsys).count("BroadcastHashJoin") >= 1


def test_ids_have_one_plan_at_both_sizes(spark, capsys):
    shapes = []
    for n in (10, 50_000):
        p = plan_of(dense_ids(spark.range(n).select(F.col("id").alias("k")), ["k"], 0), capsys)
        shapes.append(re.sub(r"#\d+L?|\d+|\[.*?\]|Location.*", "", p))
    assert shapes[0] == shapes[1]
    assert "SinglePartition" in plan_of(dense_ids(spark.range(9).select(F.col("id").alias("k")), ["k"], 0), capsys)  # of the partition sums


def test_diff_moves_no_content(spark, capsys):
    fx = Fixtures(spark, SF_SMALL)
    files, runs = fx.view("snapshots_v"), materialize(fixture_runs(fx, "other"))
    assert "content" not in plan_of(snap.changed_files(files, runs), capsys)
    # stored hashes: the content column is not even read
    stored = materialize(files.withColumn("blob", F.sha2("content", 256)))
    p = plan_of(snap.tag_snapshots(stored.select("repo_url", "snapshot_id", "path", "blob"), runs), capsys)
    assert all("content" not in x for x in re.findall(r"ReadSchema: struct<([^>]*)>", p))


def test_only_the_runs_snapshots_of_a_partitioned_table_are_read(spark, tmp_path):
    """Folders of other snapshots hold no readable Parquet: touching one would fail the job."""
    rows = [("r", s, f"f{i}.py", f"{s if i % 2 else 'same'} {i}") for s in ("base", "head") for i in range(20)]
    path = str(tmp_path / "files")
    spark.createDataFrame(rows, "repo_url string, snapshot_id string, path string, content string") \
        .write.partitionBy("snapshot_id").parquet(path)
    for other in ("older", "newer"):
        (tmp_path / "files" / f"snapshot_id={other}").mkdir()
        (tmp_path / "files" / f"snapshot_id={other}" / "part-0.parquet").write_bytes(b"PAR1 nothing to read PAR1")
    files = spark.read.schema("repo_url string, path string, content string, snapshot_id string").parquet(path)
    runs = spark.createDataFrame([("r", 1, "base", "head", "recent")],
                                 "repo_url string, repository_id bigint, base_snapshot string, head_snapshot string, mode string")
    assert snap.changed_files(files, runs).count() == 10
    result = corpus.review_corpus(files, runs, spark.createDataFrame(
        [(1, "o", "r", "r", "base", None, None)], schema.REPOSITORIES), dt.datetime(2025, 1, 1))
    assert result.feedback_rows.count() == 10
