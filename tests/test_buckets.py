"""Feedback laid out in buckets: the same nested reviews, and no exchange of feedback."""

import re

import pytest
from pyspark.sql import functions as F

from codesieve import schema
from codesieve.operators import store
from codesieve.plans.fixtures import Fixtures
from codesieve.sources import buckets
from tests.conftest import SF_SMALL
from tests.test_plans import plan_of


def _tables(spark):
    fx = Fixtures(spark, SF_SMALL)
    reviews, repos, feedback = fx.view("reviews_v"), fx.view("repositories_v"), fx.view("feedback_v")
    # a review that holds half of all files, one without any, and files of a review that is not there
    hot = feedback.withColumn("review_id", F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("review_id")))
    extra = spark.createDataFrame([(-1, 1, "c", "b", None, None)], schema.REVIEWS)
    return reviews.unionByName(extra), repos, hot.unionByName(hot.limit(3).withColumn("review_id", F.lit(-99).cast("bigint")))


def test_same_nested_reviews_without_moving_feedback(spark, tmp_path, capsys):
    reviews, repos, feedback = _tables(spark)
    path = str(tmp_path / "feedback")
    table = buckets.lay_out_feedback(feedback, "laid_out_test", path, buckets=6, chunk_files=50)
    got = buckets.nested_reviews(reviews, repos, table)
    want = store.get_review(reviews, repos, feedback, chunk_files=50)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # sort-merge, as for large headers: feedback text is in no exchange
    with_merge = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in with_merge}
    try:
        for k, v in with_merge.items():
            spark.conf.set(k, v)
        plan = plan_of(buckets.nested_reviews(reviews, repos, table), capsys, "formatted")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    exchanged = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert exchanged and all("feedback" not in x and "files" not in x and "file_path" not in x for x in exchanged)
    assert "SortMergeJoin" in plan
    # known to another session by its files alone
    spark.sql("DROP TABLE laid_out_test")
    again = buckets.laid_out(spark, "laid_out_again", path, 6)
    assert buckets.nested_reviews(reviews, repos, again).count() == got.count()
    spark.sql("DROP TABLE laid_out_again")


def test_parameters_and_empty_feedback(spark, tmp_path):
    reviews, repos, feedback = _tables(spark)
    with pytest.raises(ValueError):
        buckets.lay_out_feedback(feedback, "t", str(tmp_path), buckets=0)
    table = buckets.lay_out_feedback(feedback.limit(0), "laid_out_empty", str(tmp_path / "x"), buckets=2)
    rows = buckets.nested_reviews(reviews, repos, table).collect()
    assert len(rows) == reviews.count() and all(r.chunk == 0 and r.files == [] for r in rows)
    spark.sql("DROP TABLE laid_out_empty")
