"""File selection per review run.

Every run picks either the changed files of its repository or a
mode-dependent slice of its code files, caps it where a cap is asked for,
and keeps only paths that exist in the head snapshot.  The plan is built so
that a repository holding a large share of all files never lands whole in
one task: candidates are joined with the runs on (repository, branch), which
AQE splits, and only rows under a cap are ranked, behind a literal bound that
Catalyst turns into a ``WindowGroupLimit`` before the shuffle.  File content
is joined last, for the selected paths only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.functions import text as tx
from codesieve.session import materialize
from codesieve.sources.snapshots import is_code_file

BRANCH_CHANGED, BRANCH_ALL, BRANCH_SOURCE = "changed", "all", "source"


def normalize_mode(mode: Column, default: str = rules.DEFAULT_MODE) -> Column:
    """Empty or null mode -> default; then lower-cased."""
    return F.lower(F.coalesce(F.nullif(mode, F.lit("")), F.lit(default)))


def with_mode(runs: DataFrame | None, mode: str | None, repos: DataFrame) -> DataFrame:
    """Per-run mode table: the runs' own mode column, or one mode for every repository."""
    if runs is not None and "mode" in runs.columns:
        keys = [c for c in ("request_id", "repo_url") if c in runs.columns]
        unchanged = (F.col("base_snapshot").eqNullSafe(F.col("head_snapshot")) if "base_snapshot" in runs.columns
                     else F.lit(False))
        head = ["head_snapshot"] if "head_snapshot" in runs.columns else []
        return runs.select(*keys, normalize_mode(F.col("mode")).alias("mode"), unchanged.alias("_unchanged"), *head)
    return (repos.select("repo_url").distinct().withColumn("mode", normalize_mode(F.lit(mode)))
            .withColumn("_unchanged", F.lit(False)))


def candidates(head: DataFrame, changed: DataFrame) -> DataFrame:
    """(repo_url, path, branch): ``changed`` (every changed path, any extension, deleted ones too), ``all``
    (code files of the head snapshot) and ``source`` (code files whose extension is a source extension)."""
    code = head.select("repo_url", "path").where(is_code_file("path"))
    is_src = tx.file_extension(F.col("path")).isin(rules.SOURCE_EXTS)
    code = code.select("repo_url", "path", F.explode(
        F.when(is_src, F.array(F.lit(BRANCH_ALL), F.lit(BRANCH_SOURCE))).otherwise(F.array(F.lit(BRANCH_ALL)))
    ).alias("branch"))
    return code.unionByName(changed.select("repo_url", "path", F.lit(BRANCH_CHANGED).alias("branch")))


def select_files(head: DataFrame, changed: DataFrame, runs: DataFrame | None = None, mode: str | None = None,
                 max_files: int | None = None, smart_cap: int | None = rules.SMART_CAP,
                 recent_cap: int | None = rules.RECENT_FALLBACK_CAP, touched: DataFrame | None = None,
                 carry: list[str] | None = None) -> DataFrame:
    """([request_id,] repo_url, path, from_changes, mode) of the selection, before the exists check.

    ``runs`` carries one ``mode`` per run (else ``mode`` applies to every repository).
    full: all code files; recent: changes, else the first ``recent_cap`` code files;
    smart: changes, else source files, both capped at ``smart_cap``; any other mode:
    changes, else all code files.  Then every list is capped at ``max_files``, in path
    order.  None means no cap.  A run whose base is its head has no changes.  ``touched``: the
    repositories of ``changed`` where they are known; ``carry``: columns of the runs to keep.
    ``head`` and ``changed`` should be written keys: they are read once for the capped runs and
    once for the others.
    """
    for cap in (max_files, smart_cap, recent_cap):
        if cap is not None and cap < 0:
            raise ValueError("caps must be >= 0")
    modes = with_mode(runs, mode, head)
    keys = [c for c in modes.columns if c in ("request_id", "repo_url")]
    touched = (changed.select("repo_url").distinct() if touched is None else touched).withColumnRenamed("repo_url", "_r")
    m = F.col("mode")
    has_changes = F.col("_r").isNotNull() & ~F.col("_unchanged")
    chosen = (F.when(m == rules.MODE_FULL, F.lit(BRANCH_ALL))
              .when(has_changes, F.lit(BRANCH_CHANGED))
              .when(m == rules.MODE_SMART, F.lit(BRANCH_SOURCE))
              .otherwise(F.lit(BRANCH_ALL)))
    own = (F.when(m == rules.MODE_SMART, F.lit(smart_cap).cast("int"))
           .when((m == rules.MODE_RECENT) & ~has_changes, F.lit(recent_cap).cast("int")))
    # least() skips nulls, so a missing cap leaves the other one
    cap = F.least(own, F.lit(max_files).cast("int"))
    plan = (modes.join(touched, F.col("repo_url") == F.col("_r"), "left")
            .select(*keys, "mode", chosen.alias("branch"), cap.alias("_cap"), *(carry or [])))
    # one row per run, written: the planner sees how small it is and need not shuffle the candidates
    plan = materialize(plan, "selection-plan")
    found = candidates(head, changed)
    out = [*keys, "path", (F.col("branch") == BRANCH_CHANGED).alias("from_changes"), "mode", *(carry or [])]
    caps = [c for c in (max_files, smart_cap, recent_cap) if c is not None]
    free = found.join(plan.where(F.col("_cap").isNull()), ["repo_url", "branch"]).select(*out)
    if not caps:
        return free
    # the literal bound keeps at most that many rows of a run and map task before the shuffle
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    capped = (found.join(plan.where(F.col("_cap").isNotNull()), ["repo_url", "branch"]).withColumn("_rank", rank)
              .where(F.col("_rank") <= F.lit(max(caps))).where(F.col("_rank") <= F.col("_cap")))
    return capped.select(*out) if max_files is not None else free.unionByName(capped.select(*out))


def existing_only(selected: DataFrame, head: DataFrame, with_content: bool = True) -> DataFrame:
    """Keep selected paths present in the head snapshot, joining their content.

    The planner broadcasts a small selection (its size is known when it was written), so the head files
    stream past it; otherwise a shuffle join on ``(repo_url, path)``, evenly spread keys.
    """
    extra = ["content"] if with_content else []
    return head.select("repo_url", "path", *extra).join(selected, ["repo_url", "path"], "inner") \
        .select(*selected.columns, *extra)


def fetch_content(selected: DataFrame, files: DataFrame, runs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """P6 against the files table itself: selected paths that exist in their run's head snapshot, with content.

    The selection gets its head snapshot id (unless it carries it) and is joined with the files table on
    (repository, snapshot, path); a small one is broadcast and the files stream past it.
    """
    carry = ["content"] if carry is None else carry
    if "head_snapshot" in selected.columns:
        keyed = selected.withColumnRenamed("head_snapshot", "snapshot_id").where(F.col("snapshot_id") > "")
        selected = selected.drop("head_snapshot")
    else:
        heads = runs.select("repo_url", F.col("head_snapshot").alias("snapshot_id")).where(F.col("snapshot_id") != "").distinct()
        keyed = selected.join(heads, "repo_url", "inner")
    j = files.select("repo_url", "snapshot_id", "path", *carry).join(keyed, ["repo_url", "snapshot_id", "path"], "inner")
    return j.select(*selected.columns, *carry)


def split_rejects(files: DataFrame, unreadable: str = "content IS NULL",
                  max_path_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that can be reviewed, and rejects with a reason, instead of failing the job.

    Paths of any length pass unless ``max_path_chars`` is given.  A ``reject_reason`` that the reader
    gave comes first.
    """
    reason = F.when(F.expr(unreadable), F.lit("unreadable content"))
    if "reject_reason" in files.columns:
        reason = F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason")).when(F.expr(unreadable), F.lit("unreadable content"))
    if max_path_chars is not None:
        reason = reason.when(F.length("path") > F.lit(max_path_chars), F.lit("path too long"))
    tagged = files.withColumn("reject_reason", reason)
    ok = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = tagged.where(F.col("reject_reason").isNotNull())
    return ok, bad


def cap_files(files: DataFrame, n: int, partition_cols: list[str] | None = None,
              order_cols: list[str] | None = None) -> DataFrame:
    """First ``n`` rows per repository in path order, with their rank.

    The literal bound lets Catalyst plan a ``WindowGroupLimit`` below the
    shuffle, so at most ``n`` rows per repository leave each map task.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    w = Window.partitionBy(*(partition_cols or ["repo_url"])).orderBy(*(order_cols or ["path"]))
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(n)) \
        .withColumn("rank", F.col("rank").cast("bigint"))
