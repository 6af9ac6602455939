"""File snapshots and refs.

A snapshot table has one row per file: ``(repo_url, snapshot_id, path,
content)``; a refs table maps ``(repo_url, ref)`` to a ``snapshot_id``.
Operators here never move file content through a shuffle: diffs compare
content hashes computed inside the scan stage, of the snapshots that a run reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.functions import text as tx
from codesieve.operators.ranks import rank_within
from codesieve.session import materialize
from codesieve.sources.renames import renames_of

KEYS = ["repo_url", "path"]
_ESCAPE, _INVALID = "\x1a", "\ufffd"


def is_code_file(path: Column | str = "path") -> Column:
    """S1 predicate: one of the code suffixes and no ``/.git`` in the directory."""
    p = F.col(path) if isinstance(path, str) else path
    suffix = F.lit(False)
    for s in rules.CODE_SUFFIXES:
        suffix = suffix | p.endswith(s)
    in_vcs_dir = F.concat(F.lit("/"), tx.dirname(p)).contains(rules.VCS_DIR_MARKER)
    return suffix & ~in_vcs_dir


def code_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Files taken into a scan (filter only; pushed into the scan stage)."""
    return files.where(is_code_file(path))


def normalize_text(files: DataFrame, content: str = "content") -> DataFrame:
    """S2 for text already in a table: universal newlines."""
    return files.withColumn(content, tx.normalize_newlines(content))


def decode_text(raw: Column | str) -> Column:
    """S2 for bytes: UTF-8 with invalid bytes dropped, then universal newlines.

    Spark replaces invalid bytes by U+FFFD, which then goes.  U+FFFD of the text itself is meanwhile written
    with an escape character; its first byte never continues a sequence, so it is found in invalid bytes, too.
    """
    text = (F.col(raw) if isinstance(raw, str) else raw).cast("string")
    for old, new in ((_ESCAPE, _ESCAPE + "0"), (_INVALID, _ESCAPE + "1")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.make_valid_utf8(text)
    for old, new in ((_INVALID, ""), (_ESCAPE + "1", _INVALID), (_ESCAPE + "0", _ESCAPE), ("\r\n", "\n"), ("\r", "\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def content_hash(content: Column | str = "content") -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.sha2(c, 256)


def _classified(keyed: DataFrame) -> DataFrame:
    """keyed: (repo_url, path, in_base, in_head, base_hash, head_hash) -> (repo_url, path, status, hash) of what changed.

    Presence comes from the flags, never from a hash: unreadable content has a null hash.  Two null
    hashes are equal (unchanged).  ``keyed`` should be written: several steps read it.
    """
    status = (F.when(F.col("in_head") & ~F.col("in_base"), F.lit("A"))
              .when(F.col("in_base") & ~F.col("in_head"), F.lit("D"))
              .when(~F.col("base_hash").eqNullSafe(F.col("head_hash")), F.lit("M")))
    diff = keyed.select(*KEYS, status.alias("status"),
                        F.when(F.col("in_head"), F.col("head_hash")).otherwise(F.col("base_hash")).alias("hash"))
    return diff.where(F.col("status").isNotNull())


def _without_exact_renames(diff: DataFrame) -> DataFrame:
    """The diff without the old paths of exact renames, one deleted path per added copy (in path order).

    Added copies are counted per (repo, hash) with partial aggregation, only deletions with such a count are
    ranked, and ranking never puts a whole group into one task.  A null hash pairs with no rename.
    """
    counts = (diff.where(F.col("status").isin("A", "D") & F.col("hash").isNotNull()).groupBy("repo_url", "hash").agg(
        F.count(F.when(F.col("status") == "A", 1)).alias("_adds"),
        F.count(F.when(F.col("status") == "D", 1)).alias("_dels")).where("_adds > 0 AND _dels > 0"))
    deleted = diff.where(F.col("status") == "D")
    tagged = deleted.join(counts, ["repo_url", "hash"], "left")
    # enough added copies for every deletion: all are renames, no ranking needed
    plain = tagged.where(F.col("_adds").isNull()).select(*KEYS, "status")
    ranked = rank_within(tagged.where(F.col("_dels") > F.col("_adds")).select(*KEYS, "status", "hash", "_adds"),
                         ["repo_url", "hash"], ["path"], "_r")
    extra = ranked.where(F.col("_r") > F.col("_adds")).select(*KEYS, "status")
    return diff.where(F.col("status") != "D").select(*KEYS, "status").unionByName(plain).unionByName(extra)


def _without_renames(diff: DataFrame, pairs: DataFrame) -> DataFrame:
    """The diff without the old paths of the rename pairs."""
    old = pairs.select("repo_url", F.col("old_path").alias("path"), F.lit("D").alias("status"))
    return diff.select(*KEYS, "status").join(old, [*KEYS, "status"], "left_anti")


def _both_sides(base: DataFrame, head: DataFrame, hash_col: str | None) -> DataFrame:
    """(repo_url, path, in_base, in_head, base_hash, head_hash) of two snapshots."""
    hb = F.col(hash_col) if hash_col else content_hash()
    b = base.select(*KEYS, hb.alias("base_hash"), F.lit(True).alias("in_base"))
    h = head.select(*KEYS, hb.alias("head_hash"), F.lit(True).alias("in_head"))
    j = b.join(h, KEYS, "full_outer")
    return j.select(*KEYS, F.coalesce("in_base", F.lit(False)).alias("in_base"),
                    F.coalesce("in_head", F.lit(False)).alias("in_head"), "base_hash", "head_hash")


def snapshot_diff(base: DataFrame, head: DataFrame, hash_col: str | None = None, similar: float | None = None) -> DataFrame:
    """S3: changed paths between two snapshots of the same repositories.

    Only ``(repo_url, path, hash)`` crosses the shuffle; with ``hash_col``
    (a stored blob hash) the content is not even read.  Status is ``A``
    (only in head), ``D`` (only in base) or ``M`` (content differs).  An
    exact rename (a deleted path whose content was added under another path
    of the same repository) reports only the new path; each added copy
    pairs with one deleted path (in path order), extra deletions stay ``D``.
    With ``similar`` (0.5 is git's) an edited rename reports only the new path, too.
    """
    # changed keys and hashes only, no content: written once, read by what follows
    diff = materialize(_classified(_both_sides(base, head, hash_col)), "diff")
    if similar is None:
        return _without_exact_renames(diff)
    return _without_renames(diff, renames_of(diff, base, head, similar=similar))


def renamed_files(base: DataFrame, head: DataFrame, hash_col: str | None = None, **options) -> DataFrame:
    """S3: (repo_url, old_path, path, score) of every rename between two snapshots, exact or edited."""
    return renames_of(materialize(_classified(_both_sides(base, head, hash_col)), "diff"), base, head, **options)


def resolve_head(refs: DataFrame, branch: str = rules.DEFAULT_BRANCH) -> DataFrame:
    """Snapshot of ``branch`` per repository; ``origin/main`` falls back to ``origin/master``.

    One partial aggregation per repository (map-side combine, so a repository
    with many refs does not land in one task).  Repositories without the
    ref are absent from the result.
    """
    want = F.max(F.when(F.col("ref") == branch, F.col("snapshot_id")))
    if branch == rules.DEFAULT_BRANCH:
        fallback = F.max(F.when(F.col("ref") == rules.FALLBACK_BRANCH, F.col("snapshot_id")))
        head = F.coalesce(want, fallback)
    else:
        head = want
    return (refs.where(F.col("ref").isin(branch, rules.FALLBACK_BRANCH))
            .groupBy("repo_url").agg(head.alias("head_snapshot"))
            .where(F.col("head_snapshot").isNotNull()))


def run_sides(runs: DataFrame) -> DataFrame:
    """(repo_url, snapshot_id, side, compared) of every snapshot that a run reads; one row per repository, snapshot and side.

    compared: a run of the repository reads changes.  Runs without a base or whose base is their head see none, and
    runs in mode full never look, so their bases are not read.
    """
    wants = F.col("base_snapshot").isNotNull() & (F.col("base_snapshot") != F.col("head_snapshot"))
    if "mode" in runs.columns:
        wants = wants & (F.lower(F.coalesce(F.col("mode"), F.lit(""))) != rules.MODE_FULL)
    side = F.explode(F.array(
        F.struct(F.col("head_snapshot").alias("snapshot_id"), F.lit("head").alias("side"), wants.alias("compared")),
        F.struct(F.when(wants, F.col("base_snapshot")).alias("snapshot_id"), F.lit("base").alias("side"), wants.alias("compared"))))
    # an empty id names no snapshot; written as a comparison, which the planner takes as a reason to prune partitions
    return (runs.select("repo_url", side.alias("s")).select("repo_url", "s.snapshot_id", "s.side", "s.compared")
            .where(F.col("snapshot_id") > "").groupBy("repo_url", "snapshot_id", "side").agg(F.max("compared").alias("compared")))


def tag_snapshots(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files of the snapshots that the runs read, tagged ``side`` = base / head, by one equi join on (repository, snapshot).

    When base and head are one snapshot a file is tagged with both sides.
    """
    return files.join(run_sides(runs).drop("compared"), ["repo_url", "snapshot_id"], "inner")


def run_snapshots(files: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base files, head files) of each run ``(repo_url, base_snapshot, head_snapshot)``.

    Runs that read no changes (a first review, say) have no base files.
    """
    tagged = tag_snapshots(files, runs)
    return (tagged.where(F.col("side") == "base").drop("side"),
            tagged.where(F.col("side") == "head").drop("side"))


# runs whose snapshots (two rows of some 100 bytes a run) are sent to every task
BROADCAST_RUNS = 100_000


def run_keys(files: DataFrame, runs: DataFrame, hash_col: str | None = None) -> DataFrame:
    """S3 for runs: (repo_url, path, in_base, in_head, compared, base_hash, head_hash) of the files that the runs read, written.

    The files are read once, pruned to the runs' snapshots (other folders of a table partitioned by ``snapshot_id``
    are not read at all), and only what a run compares is hashed: (repo_url, path, hash) is all that is shuffled.
    The list of snapshots is sent to every task up to ``BROADCAST_RUNS`` runs; beyond that it is joined by shuffle with
    keys and hashes, taken before, so content is not shuffled either way.
    """
    sides = run_sides(runs)
    if runs.count() <= BROADCAST_RUNS:
        content = hash_col or "content"
        tagged = files.select("repo_url", "snapshot_id", "path", content).join(F.broadcast(sides), ["repo_url", "snapshot_id"])
        value = F.when(F.col("compared"), F.col(hash_col) if hash_col else content_hash())
    else:
        hashed = files.select("repo_url", "snapshot_id", "path", (F.col(hash_col) if hash_col else content_hash()).alias("_h"))
        tagged = hashed.join(sides, ["repo_url", "snapshot_id"])
        value = F.when(F.col("compared"), F.col("_h"))
    base, head = F.col("side") == "base", F.col("side") == "head"
    return materialize(tagged.groupBy(*KEYS).agg(
        F.max(base).alias("in_base"), F.max(head).alias("in_head"), F.max("compared").alias("compared"),
        F.max(F.when(base, value)).alias("base_hash"), F.max(F.when(head, value)).alias("head_hash")), "keys")


def head_keys(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo_url, path) of every file in each run's head snapshot; content is pruned before the join."""
    heads = runs.select("repo_url", F.col("head_snapshot").alias("snapshot_id")).where(F.col("snapshot_id") != "").distinct()
    return files.select("repo_url", "snapshot_id", "path").join(heads, ["repo_url", "snapshot_id"]).select(*KEYS)


def touched_repositories(keyed: DataFrame) -> DataFrame:
    """(repo_url) with any change; a rename changes its new path, so renames need not be known."""
    return _classified(keyed.where("compared")).select("repo_url").distinct()


def changes_of(keyed: DataFrame, files: DataFrame, runs: DataFrame, similar: float | None = None) -> DataFrame:
    """S3 from ``run_keys``: (repo_url, path, status) between base and head; none for a repository that is not compared."""
    diff = _classified(keyed.where("compared"))
    if similar is None:
        return _without_exact_renames(diff)
    base, head = run_snapshots(files, runs)
    return _without_renames(diff, renames_of(diff, base, head, similar=similar))


def changed_files(files: DataFrame, runs: DataFrame, hash_col: str | None = None, similar: float | None = None) -> DataFrame:
    """S3 per repository: changes between base and head, for runs that have a base and read changes.

    First runs see none, nor do runs whose base is their head; runs in mode full never look at changes,
    so a repository with such runs alone is not compared.
    """
    return changes_of(run_keys(files, runs, hash_col), files, runs, similar)
