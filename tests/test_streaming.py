"""Review requests arriving as a stream of files."""

import datetime as dt
import os
import tempfile

from codesieve.plans.fixtures import Fixtures
from codesieve.session import checkpoint_dir, intermediates, materialize
from codesieve.sources.tables import TableStore
from codesieve.streaming.requests import REQUEST_SCHEMA, start_review_stream
from tests.conftest import SF_SMALL


def test_intermediates_go_at_the_end_and_after_a_failure(spark):
    seen = []

    def inside(fail):
        with intermediates(spark, "run of the test") as path:
            seen.append(path)
            assert not os.path.exists(path.removeprefix("file:"))  # nothing of an earlier try
            kept = materialize(spark.range(10), "numbers")
            assert kept.count() == 10 and all(f.removeprefix("file://").startswith(path.removeprefix("file:")) for f in kept.inputFiles())
            if fail:
                raise RuntimeError("lost")

    try:
        inside(True)
    except RuntimeError:
        pass
    assert not os.path.exists(seen[0].removeprefix("file:"))
    os.makedirs(seen[0].removeprefix("file:") + "/left-by-a-killed-driver")
    inside(False)
    assert seen[0] == seen[1] and not os.path.exists(seen[0].removeprefix("file:"))
    outside = materialize(spark.range(3), "numbers")
    assert outside.count() == 3 and seen[0] not in outside.inputFiles()[0]


def test_stream_runs_each_batch_once(spark):
    fx = Fixtures(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="codesieve-stream-")
    inbox = os.path.join(root, "inbox")
    tables = TableStore(spark, os.path.join(root, "tables"))
    reqs = fx.view("runs_v").selectExpr("repo_url", "mode", "timestamp_ntz'2025-02-01 10:00:00' AS requested_at")
    spark.createDataFrame(reqs.limit(3).collect(), REQUEST_SCHEMA).write.mode("append").parquet(inbox)
    q = start_review_stream(spark, inbox, fx.view("snapshots_v"), fx.view("run_refs_v"), tables,
                            checkpoint_location=os.path.join(root, "ckpt"), available_now=True)
    q.awaitTermination(600)
    assert tables.read("reviews").count() == 3
    # the run's intermediates went with it
    assert [f for f in os.listdir(os.path.dirname(checkpoint_dir(spark).removeprefix("file:").rstrip("/")))
            if f.startswith("codesieve-") and len(f) == 42] == []
    created = {r.created_at for r in tables.read("reviews").collect()}
    assert created == {dt.datetime(2025, 2, 1, 10, 0, 0)}
    # a second start finds no new files: nothing is reviewed twice
    q = start_review_stream(spark, inbox, fx.view("snapshots_v"), fx.view("run_refs_v"), tables,
                            checkpoint_location=os.path.join(root, "ckpt"), available_now=True)
    q.awaitTermination(600)
    assert tables.read("reviews").count() == 3
    # another stream with a checkpoint of its own starts at batch 0 again and replaces nothing
    other = os.path.join(root, "inbox2")
    last = [*reqs.orderBy("repo_url").limit(5).collect()[3:], (None, "full", None)]
    spark.createDataFrame([tuple(r) for r in last], REQUEST_SCHEMA).write.mode("append").parquet(other)
    before = {r.id for r in tables.read("reviews").collect()}
    q = start_review_stream(spark, other, fx.view("snapshots_v"), fx.view("run_refs_v"), tables,
                            checkpoint_location=os.path.join(root, "ckpt2"), available_now=True)
    q.awaitTermination(600)
    after = {r.id for r in tables.read("reviews").collect()}
    assert before < after and len(after) == 5
    assert tables.read("outcomes").where("status = 'rejected'").select("reason").collect()[0].reason == "missing repo"
