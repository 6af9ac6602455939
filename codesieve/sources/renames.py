"""Renames between two snapshots: exact ones by content hash, edited ones by what their lines share (S3).

``git diff --name-only`` reports a renamed file under its new name only, also where it was edited on
the way.  The rules kept here: a file is cut into chunks (a line, at most 64 characters); two files
are as similar as the bytes of the chunks they share are to the larger file; a name that is the only
one of its kind among the files left on both sides is tried first and needs 75 per cent; then the most similar
pairs are taken, each file once, from 50 per cent on, equal names first; a repository with more than
``rename_limit`` x ``rename_limit`` pairs left is not searched.

No file is compared with all others.  Chunks are ordered by how many files hold them; of each file
only the rarest are looked up, so many that what is left is under half of it.  Two files that share
half of the larger one share one of those chunks: no pair is lost, and common lines stay out of the
lookup.  The matching takes, round by round, the pairs that are the best of both their files; that
gives what taking pairs one by one in order gives, without a task that sees a whole repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.operators.ranks import rank_within
from codesieve.session import materialize

KEYS = ["repo_url", "path"]
SIMILAR, SIMILAR_NAME, RENAME_LIMIT = 0.5, 0.75, 1000
CHUNK = "[^\\n]{0,63}\\n|[^\\n]{1,64}"  # a line, or 64 characters of a longer one


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def exact_renames(diff: DataFrame) -> DataFrame:
    """(repo_url, old_path, path): deleted and added paths of equal content, paired in path order.

    diff: (repo_url, path, status, hash) with A, D rows; a null hash pairs with nothing.
    """
    moved = diff.where(F.col("status").isin("A", "D") & F.col("hash").isNotNull())
    both = (moved.groupBy("repo_url", "hash").agg(F.count_distinct("status").alias("_n")).where("_n = 2").drop("_n"))
    ranked = rank_within(moved.join(both, ["repo_url", "hash"]).select("repo_url", "hash", "status", "path"),
                         ["repo_url", "hash", "status"], ["path"], "_r")
    old = ranked.where("status = 'D'").select("repo_url", "hash", "_r", F.col("path").alias("old_path"))
    new = ranked.where("status = 'A'").select("repo_url", "hash", "_r", "path")
    return old.join(new, ["repo_url", "hash", "_r"]).select("repo_url", "old_path", "path")


def chunk_bags(files: DataFrame, content: str = "content") -> DataFrame:
    """(repo_url, path, side, size, chunk, bytes): the chunks of each file as 64-bit hashes, with all their bytes.

    Line ends count alike, CRLF or LF.  A file without content or with none readable has no chunk.
    """
    text = F.replace(F.col(content), F.lit("\r\n"), F.lit("\n"))
    pieces = F.explode(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))).alias("piece")
    return (files.select(*KEYS, "side", F.octet_length(text).alias("size"), pieces)
            .groupBy(*KEYS, "side", "size", F.xxhash64("piece").alias("chunk"))
            .agg(F.sum(F.octet_length("piece")).alias("bytes")))


def _scores(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """pairs (repo_url, old_path, path) with ``score``: shared bytes over the larger size."""
    old = bags.where("side = 'D'").select("repo_url", F.col("path").alias("old_path"), "chunk", F.col("bytes").alias("_b"),
                                          F.col("size").alias("_s"))
    new = bags.where("side = 'A'").select("repo_url", "path", "chunk", "bytes", "size")
    shared = pairs.join(old, ["repo_url", "old_path"]).join(new, ["repo_url", "path", "chunk"])
    return (shared.groupBy("repo_url", "old_path", "path")
            .agg(F.sum(F.least("bytes", "_b")).alias("_shared"), F.max(F.greatest("size", "_s")).alias("_size"))
            .select("repo_url", "old_path", "path", (F.col("_shared") / F.col("_size")).alias("score")))


def _unique_names(names: DataFrame) -> DataFrame:
    """Pairs of a deleted and an added file whose name occurs once on each side of a repository.

    Counts only: a name that thousands of files bear is one row here.
    """
    side = lambda s, f: F.when(F.col("side") == s, f)
    one = names.groupBy("repo_url", basename(F.col("path")).alias("_name")).agg(
        F.count(side("D", 1)).alias("_d"), F.count(side("A", 1)).alias("_a"),
        F.min(side("D", F.col("path"))).alias("old_path"), F.min(side("A", F.col("path"))).alias("path"))
    return one.where("_d = 1 AND _a = 1").select("repo_url", "old_path", "path")


def _candidates(bags: DataFrame, similar: float) -> DataFrame:
    """Pairs that share one of the chunks looked up for both; every pair as similar as asked for is among them."""
    held = bags.groupBy("repo_url", "chunk").agg(F.count(F.lit(1)).alias("_files"), F.count_distinct("side").alias("_sides"))
    rare = bags.join(held, ["repo_url", "chunk"])
    # a file's chunks from rare to common; one is looked up while what it and those after it hold reaches the bound
    order = Window.partitionBy(*KEYS, "side").orderBy("_files", "chunk")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    looked = (rare.withColumn("_left", F.col("size") - before).where(F.col("_left") >= F.lit(similar) * F.col("size"))
              .where("_sides = 2").select(*KEYS, "side", "chunk", "size"))
    old = looked.where("side = 'D'").select("repo_url", "chunk", F.col("path").alias("old_path"), F.col("size").alias("_s"))
    new = looked.where("side = 'A'").select("repo_url", "chunk", "path", "size")
    near = F.least("size", "_s") >= F.lit(similar) * F.greatest("size", "_s")  # sizes too far apart share too little
    return old.join(new, ["repo_url", "chunk"]).where(near).select("repo_url", "old_path", "path").distinct()


def _greedy(scored: DataFrame) -> DataFrame:
    """One-to-one pairs by falling score, then equal names, then paths: rounds of pairs that are best for both files."""
    named = (basename(F.col("old_path")) != basename(F.col("path")))
    key = F.struct((-F.col("score")).alias("s"), named.alias("n"), F.col("path").alias("p"), F.col("old_path").alias("o"))
    left = materialize(scored.withColumn("_key", key), "rename-pairs")
    taken: DataFrame | None = None
    while not left.isEmpty():
        by_old = left.groupBy("repo_url", "old_path").agg(F.min("_key").alias("_key"))
        by_new = left.groupBy("repo_url", "path").agg(F.min("_key").alias("_key"))
        best = materialize(by_old.join(by_new, ["repo_url", "_key"]).select("repo_url", "old_path", "path", (-F.col("_key.s")).alias("score")),
                           "renames")
        taken = best if taken is None else taken.unionByName(best)
        left = materialize(left.join(best.select("repo_url", "old_path"), ["repo_url", "old_path"], "left_anti")
                           .join(best.select("repo_url", "path"), ["repo_url", "path"], "left_anti"), "rename-pairs")
    return left.select("repo_url", "old_path", "path", "score") if taken is None else taken


def similar_renames(deleted: DataFrame, added: DataFrame, similar: float = SIMILAR, similar_name: float = SIMILAR_NAME,
                    rename_limit: int | None = RENAME_LIMIT, content: str = "content") -> DataFrame:
    """(repo_url, old_path, path, score): deleted files that live on, edited, under an added path; each file once.

    deleted, added: (repo_url, path, content) of files that have no exact partner.  ``rename_limit`` None searches
    every repository.  A file of only common chunks looks those up, so the work then grows with its like; the limit
    bounds it.
    """
    if not 0 < similar <= 1:
        raise ValueError("similar must be above 0 and at most 1")
    tagged = (deleted.select(*KEYS, content, F.lit("D").alias("side"))
              .unionByName(added.select(*KEYS, content, F.lit("A").alias("side"))))
    # chunks of deleted and added files alone; every step below reads this narrow table
    bags = materialize(chunk_bags(tagged, content), "chunks")
    names = bags.select(*KEYS, "side").distinct()
    by_name = materialize(_scores(_unique_names(names), bags).where(F.col("score") >= F.lit(similar_name)), "renames")
    old, new = by_name.select("repo_url", F.col("old_path").alias("path"), F.lit("D").alias("side")), by_name.select("repo_url", "path", F.lit("A").alias("side"))
    rest = bags.join(old.unionByName(new), [*KEYS, "side"], "left_anti")
    if rename_limit is not None:
        files = rest.select(*KEYS, "side").distinct().groupBy("repo_url").agg(
            F.count(F.when(F.col("side") == "D", 1)).alias("_d"), F.count(F.when(F.col("side") == "A", 1)).alias("_a"))
        within = files.where(F.col("_d") * F.col("_a") <= F.lit(rename_limit * rename_limit)).select("repo_url")
        rest = rest.join(within, "repo_url", "left_semi")
    rest = materialize(rest, "chunks")
    scored = _scores(_candidates(rest, similar), rest).where(F.col("score") >= F.lit(similar))
    return by_name.unionByName(_greedy(scored))


def renames_of(diff: DataFrame, base: DataFrame, head: DataFrame, content: str = "content", **options) -> DataFrame:
    """(repo_url, old_path, path, score): exact renames (score 1), then similar ones among the files left.

    diff: (repo_url, path, status, hash) between base and head, written; only deleted and added files are read again.
    """
    exact = materialize(exact_renames(diff), "renames")
    gone = diff.where("status = 'D'").select(*KEYS).join(exact.select("repo_url", F.col("old_path").alias("path")), KEYS, "left_anti")
    come = diff.where("status = 'A'").select(*KEYS).join(exact.select(*KEYS), KEYS, "left_anti")
    similar = similar_renames(base.select(*KEYS, content).join(gone, KEYS, "left_semi"),
                              head.select(*KEYS, content).join(come, KEYS, "left_semi"), content=content, **options)
    return exact.withColumn("score", F.lit(1.0)).unionByName(similar)
