"""A repository holding a third of all files: selection and review stay exact."""

import os

import pandas as pd
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.operators import select as sel
from codesieve.operators import store
from tests.conftest import SF_MID

EXTS = [".py", ".md", ".bin", ".js", ".txt"]


def _skewed_head(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("doc_id") % len(EXTS) + 1).cast("int"))
    return docs.select(
        F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source")).alias("repo_url"),
        F.concat(F.lit("d/f"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), ext).alias("path"),
        F.col("text").alias("content"))


def _brute(head: pd.DataFrame, changed: pd.DataFrame, modes: dict, max_files: int) -> set:
    out = set()
    for repo, g in head.groupby("repo_url"):
        paths = sorted(g.path)
        code = [p for p in paths if any(p.endswith(s) for s in rules.CODE_SUFFIXES)]
        ch = sorted(changed[changed.repo_url == repo].path)
        mode = modes[repo]
        if mode == "full":
            pick = code
        elif mode == "recent":
            pick = ch if ch else code[:10]
        elif mode == "smart":
            pick = ch if ch else [p for p in code if os.path.splitext(p)[1] in rules.SOURCE_EXTS]
            pick = pick[:20]
        else:
            pick = ch if ch else code
        out |= {(repo, p) for p in pick[:max_files]}
    return out


def test_hot_repository_selection_matches_brute_force(spark):
    head = _skewed_head(spark)
    repos = [r[0] for r in head.select("repo_url").distinct().collect()]
    mode_list = ["full", "recent", "smart", "other"]
    modes = {r: mode_list[i % 4] for i, r in enumerate(sorted(repos))}
    runs = spark.createDataFrame(list(modes.items()), "repo_url string, mode string")
    # changes only for every other repository, the hot one included
    changed = head.where((F.length("repo_url") % 2 == 1) & (F.col("path").substr(-2, 2) == "py")) \
        .select("repo_url", "path", F.lit("M").alias("status"))
    got = {(r.repo_url, r.path) for r in sel.select_files(head, changed, runs=runs, max_files=30).collect()}
    want = _brute(head.toPandas(), changed.toPandas(), modes, 30)
    assert got == want
    per_repo = head.groupBy("repo_url").count().orderBy(F.desc("count")).first()
    assert per_repo.repo_url == "hot" and per_repo["count"] >= head.count() // 3


def test_hot_repository_listing_top_k(spark):
    reviews = spark.read.parquet(f"{SF_MID}/orders.parquet").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")).alias("repository_id"),
        F.lit("c").alias("commit_sha"), F.lit("b").alias("branch"), F.lit(None).cast("string").alias("pr_url"),
        F.col("o_orderdate").alias("created_at"))
    repos = spark.read.parquet(f"{SF_MID}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("u"), F.col("c_custkey")).alias("url"),
        F.lit("o").alias("owner"), F.col("c_name").alias("name"))
    got = store.list_reviews_per_repo(reviews, repos, limit=5).where(F.col("repository") == "u1")
    pdf = reviews.where(F.col("repository_id") == 1).toPandas().sort_values(["created_at", "id"],
                                                                           ascending=[False, False])
    assert [r.id for r in got.orderBy("position").collect()] == list(pdf.id[:5])
