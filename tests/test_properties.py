"""Properties of selection, diff, upsert and the end-to-end run."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.operators import feedback as fb
from codesieve.operators import select as sel
from codesieve.operators import store
from codesieve.operators.ids import first_id, run_of
from codesieve.plans import corpus
from codesieve.plans.fixtures import Fixtures
from codesieve.plans.queries_select import fixture_runs
from codesieve.sources import snapshots as snap
from codesieve import schema as sch
from codesieve.sources.tables import TableStore
from tests.conftest import SF_SMALL

TS = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_SMALL)


@pytest.mark.parametrize("mode", ["full", "recent", "smart", "other"])
def test_caps_and_their_absence(fx, mode):
    files = fx.view("snapshots_v")
    runs = fixture_runs(fx, mode)
    changed = snap.changed_files(files, runs)
    _, head = snap.run_snapshots(files, runs)
    worst = lambda s: s.groupBy("repo_url").count().agg(F.max("count")).first()[0] or 0
    assert worst(sel.select_files(head, changed, runs=runs)) <= (20 if mode == "smart" else 10**9)
    # without any cap every file of the chosen list comes
    free = sel.select_files(head, changed, runs=runs, smart_cap=None, recent_cap=None)
    code, chg = snap.code_files(head).groupBy("repo_url").count().collect(), changed.groupBy("repo_url").count().collect()
    sizes = {r.repo_url: r["count"] for r in code} if mode == "full" else {**{r.repo_url: r["count"] for r in code},
                                                                           **{r.repo_url: r["count"] for r in chg}}
    if mode != "smart":
        assert {r.repo_url: r["count"] for r in free.groupBy("repo_url").count().collect()} == sizes
    small = sel.select_files(head, changed, runs=runs, max_files=3)
    assert (small.groupBy("repo_url").count().agg(F.max("count")).first()[0] or 0) <= 3


def test_recent_without_changes_takes_ten(fx):
    files = fx.view("snapshots_v")
    runs = fixture_runs(fx, "recent").withColumn("base_snapshot", F.lit(None).cast("string"))
    changed = snap.changed_files(files, runs)
    assert changed.count() == 0
    _, head = snap.run_snapshots(files, runs)
    s = sel.select_files(head, changed, runs=runs)
    per_repo = {r[0]: r[1] for r in s.groupBy("repo_url").count().collect()}
    code = snap.code_files(head).groupBy("repo_url").count().collect()
    for repo, n in code:
        assert per_repo.get(repo, 0) == min(n, rules.RECENT_FALLBACK_CAP)


def test_diff_of_snapshot_with_itself_is_empty(fx):
    files = fx.view("snapshots_v")
    runs = fixture_runs(fx, "full").withColumn("base_snapshot", F.col("head_snapshot"))
    assert snap.changed_files(files, runs).count() == 0
    head = fx.view("files_v")
    assert snap.snapshot_diff(head, head).count() == 0


def test_exact_rename_reports_new_path_only(spark):
    base = spark.createDataFrame([("r", "a.py", "x"), ("r", "b.py", "y"), ("r", "c.py", "z")],
                                 "repo_url string, path string, content string")
    head = spark.createDataFrame([("r", "a2.py", "x"), ("r", "b.py", "y2"), ("r", "d.py", "w")],
                                 "repo_url string, path string, content string")
    got = {(r.path, r.status) for r in snap.snapshot_diff(base, head).collect()}
    assert got == {("a2.py", "A"), ("b.py", "M"), ("c.py", "D"), ("d.py", "A")}


def test_upsert_is_idempotent(fx):
    existing = fx.view("repositories_v")
    incoming = fx.view("requests_v").select(F.col("repo").alias("url"))
    once = store.upsert_repositories(existing, incoming, TS, first_id(1))
    once = once.checkpoint()
    twice = store.upsert_repositories(once, incoming, TS, first_id(2))
    assert once.count() == twice.count()
    assert once.select("url").distinct().count() == once.count()
    ids = [r[0] for r in once.select("id").collect()]
    assert len(set(ids)) == len(ids)


def test_dense_ids_are_dense(spark):
    from codesieve.operators.ids import dense_ids

    df = spark.range(0, 1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"))
    for n in (1, 7):
        out = dense_ids(df.repartition(n), ["k"], 41)
        rows = sorted((r.k, r.id) for r in out.collect())
        assert [i for _, i in rows] == list(range(42, 1042))
    assert dense_ids(df.limit(0), ["k"], 41).count() == 0


def test_review_invariant_under_repartition(fx):
    files = fx.view("files_v")
    a = fb.review_files(files, keys=["repo_url", "doc_id"])
    b = fb.review_files(files.repartition(5, "doc_id"), keys=["repo_url", "doc_id"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _inputs(fx):
    return fx.view("snapshots_v"), fx.view("run_refs_v"), fx.view("runs_v")


def _stored(tables):
    """Everything that readers see, as comparable rows."""
    return {t: sorted(map(str, tables.read(t).collect())) for t in ("repositories", "reviews", "file_feedback", "outcomes", "file_rejects")}


def test_run_review_end_to_end(spark, fx, tmp_path):
    tables = TableStore(spark, str(tmp_path / "store"))
    files, refs, requests = _inputs(fx)
    n_runs = requests.join(refs.select("repo_url").distinct(), "repo_url").count()
    annotated = str(tmp_path / "annotated")
    summary = corpus.run_review(tables, files, refs, requests, TS, "one", annotated_path=annotated).collect()
    assert len(summary) == n_runs > 0
    patched = spark.read.parquet(f"{annotated}/run=1")
    assert patched.count() == sum(r.files_reviewed for r in summary)
    assert patched.where(~F.col("annotated").contains(" --- Auto Review (")).count() == 0
    reviews, fbk, repos = (tables.read(t) for t in ("reviews", "file_feedback", "repositories"))
    assert reviews.count() == n_runs
    assert fbk.count() == sum(r.files_reviewed for r in summary)
    # one feedback row per selected existing file, and every review header has its rows
    assert fbk.groupBy("review_id", "file_path").count().where("count > 1").count() == 0
    marks = {r.url: r.last_reviewed_commit for r in repos.collect()}
    assert all(marks[r.repository] == "head" for r in summary)
    # second run on the same commit: no changes, new headers appended, marks stay, the first copies stay
    summary2 = corpus.run_review(tables, files, refs, requests, TS + dt.timedelta(days=1), "two", annotated_path=annotated).collect()
    assert len(summary2) == n_runs
    assert tables.read("reviews").count() == 2 * n_runs
    assert len({r.review_id for r in summary2} & {r.review_id for r in summary}) == 0
    assert spark.read.parquet(f"{annotated}/run=1").count() == patched.count()
    one = store.get_review(*(tables.read(t) for t in ("reviews", "repositories", "file_feedback")),
                           review_id=summary[0].review_id, chunk_files=4).collect()
    assert [r.chunk for r in sorted(one, key=lambda r: r.chunk)] == list(range(max(1, -(-summary[0].files_reviewed // 4))))
    assert sum(len(r.files) for r in one) == summary[0].files_reviewed and all(len(r.files) <= 4 for r in one)
    none = store.get_review(*(tables.read(t) for t in ("reviews", "repositories", "file_feedback")), review_id=-5).collect()
    assert none == []
    # ids say which run's folder to read
    assert run_of(summary[0].review_id) == 1 and run_of(summary2[0].review_id) == 2
    assert tables.read_review("file_feedback", summary[0].review_id).count() == summary[0].files_reviewed
    assert tables.read_review("reviews", first_id(9)).count() == 0


class Broken(Exception):
    pass


def _small(spark):
    """(files, refs, requests): two repositories, one asked for twice and one request that is rejected."""
    rows = [(f"https://h/o/r{r}", c, f"f{i}.py", f"x = {i}{c if i == 3 else ''}") for r in (1, 2) for c in ("c1", "c2") for i in range(4)]
    files = spark.createDataFrame(rows, "repo_url string, snapshot_id string, path string, content string").coalesce(1).cache()
    refs = spark.createDataFrame([(f"https://h/o/r{r}", "origin/main", "c2") for r in (1, 2)],
                                 "repo_url string, ref string, snapshot_id string").coalesce(1)
    asked = [(1, "https://h/o/r1", "full"), (2, "https://h/o/r2", "recent"), (3, "https://h/o/r1", "smart"), (4, "https://h/o", "full")]
    return files, refs, spark.createDataFrame(asked, "request_id long, repo_url string, mode string").coalesce(1)


@pytest.fixture(scope="module")
def good_run(spark, tmp_path_factory):
    tables = TableStore(spark, str(tmp_path_factory.mktemp("good")))
    corpus.run_review(tables, *_small(spark), TS, "run")
    return _stored(tables)


@pytest.mark.parametrize("fails_at", ["outcomes", "file_feedback", "repositories", "commit"])
def test_a_run_that_breaks_off_is_redone_alike(spark, good_run, tmp_path, monkeypatch, fails_at):
    files, refs, requests = _small(spark)
    tables = TableStore(spark, str(tmp_path / "store"))
    write = TableStore.write

    def failing_write(self, table, rows, run):
        write(self, table, rows, run)
        if table == fails_at:
            raise Broken

    def failing_commit(self, run, run_id, after=None):
        raise Broken

    with monkeypatch.context() as m:
        m.setattr(TableStore, *(("commit", failing_commit) if fails_at == "commit" else ("write", failing_write)))
        with pytest.raises(Broken):
            corpus.run_review(tables, files, refs, requests, TS, "run")
    assert tables.read("reviews").count() == tables.read("file_feedback").count() == tables.read("repositories").count() == 0
    first = sorted(corpus.run_review(tables, files, refs, requests, TS, "run").collect())
    assert _stored(tables) == good_run
    # asked once more after the commit, it answers the same and writes nothing
    assert sorted(corpus.run_review(tables, files, refs, requests.limit(0), TS + dt.timedelta(days=9), "run").collect()) == first
    assert _stored(tables) == good_run


def test_writers_never_share_a_run(spark, tmp_path):
    a, b = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    assert a.begin("s1/0") == b.begin("s1/0") == 1
    assert b.begin("s2/0") == 2 and a.begin("s2/0") == 2 and a.begin("s1/1") == 3
    rows = spark.createDataFrame([(1, "o", "n", "u", "m1", None, None)], sch.REPOSITORIES)
    newer = spark.createDataFrame([(1, "o", "n", "u", "m2", None, None)], sch.REPOSITORIES)
    a.write("repositories", newer, 2)
    b.write("repositories", rows, 1)
    a.commit(1, "s1/0")
    assert [r.last_reviewed_commit for r in b.read("repositories").collect()] == ["m1"]
    b.commit(2, "s2/0")
    assert [r.last_reviewed_commit for r in a.read("repositories").collect()] == ["m2"]
    assert a.compact_repositories("compact") == 4
    assert [r.last_reviewed_commit for r in b.read("repositories").collect()] == ["m2"]


def _planned(tables, files, refs, requests, run_id):
    """A run that has stored its plan and no more."""
    corpus._store_plan(tables, tables.begin(run_id), requests, refs, TS, "origin/main", "full")


def test_overlapping_runs_share_a_new_repository(spark, tmp_path):
    files, refs, requests = _small(spark)
    a, b = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    _planned(a, files, refs, requests, "one")
    _planned(b, files, refs, requests.where("request_id < 3"), "two")
    corpus.run_review(b, files, refs, requests, TS, "two")
    corpus.run_review(a, files, refs, requests, TS, "one")
    reviews, repos = a.read("reviews"), a.read("repositories")
    assert sorted(r.url for r in repos.collect()) == ["https://h/o/r1", "https://h/o/r2"]
    assert all(run_of(r.id) == 2 for r in repos.collect())  # the first to commit
    listed = store.list_reviews(reviews, repos, limit=100).collect()
    assert len(listed) == reviews.count() == 5 and {run_of(r.id) for r in listed} == {1, 2}
    assert a.read("file_feedback").select("review_id").distinct().count() == 5


def test_the_last_commit_sets_the_mark(spark, tmp_path):
    """A run that began first, planned later and committed last, at the newer head; then one that reviews nothing."""
    files, refs, requests = _small(spark)
    tables = TableStore(spark, str(tmp_path))
    assert tables.begin("slow") == 1
    old_refs = refs.withColumn("snapshot_id", F.lit("c1"))
    corpus.run_review(tables, files, old_refs, requests, TS, "quick")
    none = refs.withColumn("ref", F.lit("origin/dev"))
    _planned(tables, files, none, requests, "rejected")  # knows the repositories at c1, reviews none
    corpus.run_review(tables, files, refs, requests, TS, "slow")
    corpus.run_review(tables, files, none, requests, TS, "rejected")
    assert {r.last_reviewed_commit for r in tables.read("repositories").collect()} == {"c2"}
    assert [r.seq for r in tables.commits().orderBy("seq").collect()] == [1, 2, 3]
    assert [r.run for r in tables.commits().orderBy("seq").collect()] == [2, 1, 3]


def test_a_commit_that_another_run_overtook_is_settled_again(spark, tmp_path, monkeypatch):
    files, refs, requests = _small(spark)
    a, b = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    _planned(a, files, refs, requests, "one")
    _planned(b, files, refs, requests, "two")
    settle, seen = corpus.settle, []

    def overtaken(tables, run, *rest):
        settle(tables, run, *rest)
        seen.append(run)
        if seen == [1]:  # between the look at the store and the commit of run 1
            corpus.run_review(b, files, refs, requests, TS, "two")

    monkeypatch.setattr(corpus, "settle", overtaken)
    corpus.run_review(a, files, refs, requests, TS, "one")
    assert seen == [1, 2, 1]
    reviews, repos = a.read("reviews"), a.read("repositories")
    assert repos.count() == 2 and store.list_reviews(reviews, repos, limit=100).count() == reviews.count() == 6


def test_commit_record_survives_a_lost_short_cut(spark, tmp_path):
    tables = TableStore(spark, str(tmp_path))
    run = tables.begin("r")
    assert tables.commit(run, "r") and tables.committed(run)
    (tmp_path / "commits" / f"run-{run}").unlink()
    assert tables.committed(run) and tables.commit(run, "r") and tables.last_commit() == 1
    other = tables.begin("s")
    assert not tables.commit(other, "s", after=0) and not tables.committed(other)
    assert tables.commit(other, "s", after=1) and tables.last_commit() == 2


def test_every_request_gets_an_outcome(spark, tmp_path):
    files = spark.createDataFrame([("https://h/o/r", "c1", f"f{i:02d}.py", "x = 1") for i in range(14)]
                                  + [("https://h/o/r", "c1", "bad.py", None)],
                                  "repo_url string, snapshot_id string, path string, content string")
    refs = spark.createDataFrame([("https://h/o/r", "origin/main", "c1")], "repo_url string, ref string, snapshot_id string")
    requests = spark.createDataFrame([(1, "https://h/o/r", "full"), (2, "https://h/o/r", "recent"), (3, "https://h/solo", "full"),
                                      (4, None, "full"), (5, "https://h/o/none", ""), (6, "https://h/o/r", None)],
                                     "request_id long, repo_url string, mode string")
    tables = TableStore(spark, str(tmp_path))
    summary = corpus.run_review(tables, files, refs, requests, TS, "batch").collect()
    out = {r.request_id: (r.status, r.reason, r.review_id) for r in tables.read("outcomes").collect()}
    base = first_id(1)
    assert out == {1: ("accepted", None, base + 1), 2: ("accepted", None, base + 2), 3: ("rejected", "invalid repository url", None),
                   4: ("rejected", "missing repo", None), 5: ("rejected", "branch not found", None), 6: ("accepted", None, base + 3)}
    # the first ten of a recent run hold the unreadable file, which is reported and not reviewed
    assert {(r.review_id, r.mode, r.files_reviewed) for r in summary} == {(base + 1, "full", 14), (base + 2, "recent", 9), (base + 3, "full", 14)}
    assert sorted((r.request_id, r.path, r.reason) for r in tables.read("file_rejects").collect()) == [
        (i, "bad.py", "unreadable content") for i in (1, 2, 6)]
    assert [r.last_reviewed_commit for r in tables.read("repositories").orderBy("url").collect()] == [None, "c1"]


def test_later_request_of_a_batch_sees_no_changes(spark, tmp_path):
    rows = [("https://h/o/r", c, f"f{i}.py", f"x = {i}{c if i == 3 else ''}") for c in ("c1", "c2") for i in range(5)]
    files = spark.createDataFrame(rows, "repo_url string, snapshot_id string, path string, content string")
    tables = TableStore(spark, str(tmp_path))
    for commit, ids_, want in (("c1", (1,), [(1, 5)]), ("c2", (1, 2), [(1, 1), (2, 5)])):
        refs = spark.createDataFrame([("https://h/o/r", "origin/main", commit)], "repo_url string, ref string, snapshot_id string")
        requests = spark.createDataFrame([(i, "https://h/o/r", "other") for i in ids_], "request_id long, repo_url string, mode string")
        summary = corpus.run_review(tables, files, refs, requests, TS, commit).collect()
        assert sorted((r.review_id & 0xFF, r.files_reviewed) for r in summary) == want


def test_list_reviews_filter_before_limit(fx):
    reviews, repos = fx.view("reviews_v"), fx.view("repositories_v")
    url = repos.orderBy("id").first().url
    rows = store.list_reviews(reviews, repos, repo=url, limit=5).collect()
    assert 0 < len(rows) <= 5 and all(r.repository == url for r in rows)
    with pytest.raises(ValueError):
        store.list_reviews(reviews, repos, limit=0)
    with pytest.raises(ValueError):
        store.list_reviews(reviews, repos, limit=101)


def test_watermark_moves_only_for_runs(fx):
    repos = fx.view("run_repositories_v")
    runs = fixture_runs(fx, "full")
    before = {r.url: (r.last_reviewed_commit, r.updated_at) for r in repos.collect()}
    after = {r.url: (r.last_reviewed_commit, r.updated_at) for r in store.advance_watermark(repos, runs, TS).collect()}
    heads = {r.repo_url: r.head_snapshot for r in runs.collect()}
    assert set(after) == set(before)
    for url, (mark, upd) in after.items():
        if url in heads:
            assert mark == heads[url] and upd == TS
        else:
            assert (mark, upd) == before[url]


NULLS = "repo_url string, path string, content string"


def test_unreadable_content_is_present_all_the_same(spark):
    base = spark.createDataFrame([("r", "same", None), ("r", "lost", "x"), ("r", "found", None), ("r", "gone", None), ("r", "k", "k")], NULLS)
    head = spark.createDataFrame([("r", "same", None), ("r", "lost", None), ("r", "found", "y"), ("r", "new", None), ("r", "k", "k")], NULLS)
    want = {("lost", "M"), ("found", "M"), ("gone", "D"), ("new", "A")}
    assert {(r.path, r.status) for r in snap.snapshot_diff(base, head).collect()} == want
    files = base.withColumn("snapshot_id", F.lit("b")).unionByName(head.withColumn("snapshot_id", F.lit("h")))
    runs = spark.createDataFrame([("r", "b", "h")], "repo_url string, base_snapshot string, head_snapshot string")
    assert {(r.path, r.status) for r in snap.changed_files(files, runs).collect()} == want


def test_diff_at_volume(spark):
    """Half as many added copies as deletions of one content: as many deletions stay, whatever the sampling of ranges."""
    base = spark.range(400_000).select(F.lit("r").alias("repo_url"), F.concat(F.lit("old/"), F.col("id")).alias("path"),
                                       F.lit("x").alias("content"))
    head = spark.range(200_000).select(F.lit("r").alias("repo_url"), F.concat(F.lit("new/"), F.col("id")).alias("path"),
                                       F.lit("x").alias("content"))
    diff = snap.snapshot_diff(base, head)
    for _ in range(2):
        assert {r.status: r["count"] for r in diff.groupBy("status").count().collect()} == {"A": 200_000, "D": 200_000}


def test_rank_within_with_columns_carried_along(spark):
    df = spark.range(600_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
                                     F.xxhash64("id").alias("o"), F.repeat(F.lit("x"), 40).alias("carried"), (F.col("id") % 5).alias("n"))
    from pyspark.sql import Window

    from codesieve.operators.ranks import rank_within

    got = rank_within(df, ["g"], ["o"], "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("bigint"))
    assert got.columns == want.columns
    for cols in (["g", "o", "r"], got.columns, ["o", "n", "r"]):
        a, b = got.select(*cols), want.select(*cols)
        assert a.count() == 600_000 and a.exceptAll(b).count() == 0


def test_stored_hash_gives_the_same_diff_without_reading_content(fx, capsys):
    files = fx.view("snapshots_v")
    runs = fixture_runs(fx, "recent")
    with_blob = files.withColumn("blob", F.sha2("content", 256))
    a = snap.changed_files(files, runs)
    b = snap.changed_files(with_blob.drop("content").withColumn("content", F.lit(None).cast("string")), runs,
                           hash_col="blob")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rename_pairs_one_deletion_per_added_copy(spark):
    base = spark.createDataFrame([("r", "a.py", "x"), ("r", "b.py", "x"), ("r", "c.py", "x"), ("r", "k.py", "k")],
                                 "repo_url string, path string, content string")
    head = spark.createDataFrame([("r", "n.py", "x"), ("r", "k.py", "k")], "repo_url string, path string, content string")
    got = {(r.path, r.status) for r in snap.snapshot_diff(base, head).collect()}
    assert got == {("n.py", "A"), ("b.py", "D"), ("c.py", "D")}


def test_rank_within_hot_group_matches_row_number(spark):
    from pyspark.sql import Window

    from codesieve.operators.ranks import rank_within

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source")).alias("g"), "doc_id")
    got = rank_within(docs.repartition(5), ["g"], ["doc_id"], "r")
    want = docs.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("doc_id")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
