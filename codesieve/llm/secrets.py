"""Secret scan with an incremental blob ledger.  DataFrame functions only.

Every version of a file is a row (path, text).  Its text is a blob, named by its SHA-256.  The
ledger (a Parquet folder) has one row for each scan of a blob: the rules, with their versions,
that were applied and what they found.  A run scans only the pairs of blob and rule version that
the ledger lacks, appends them, and joins all findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.common import fresh_names, stored
from codesieve.llm.spans import as_kind, count_kind, replace_spans, span_list, spans_if
from codesieve.session import shared_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java pattern, group whose length counts (0: all), least length, necessary condition."""

    kind: str
    version: int
    pattern: str
    part: int = 0
    least: int = 1
    needs: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", 2, 8,
         r"(?i)password|passwd|secret|token|api_?key"),
    Rule("access", 1, r"AKIA[A-Z0-9]++", 0, 16, "AKIA[A-Z0-9]"),
    # whole runs: a match starts where a run starts, and shorter runs fail anyway
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32, None),
)
OWN_RULES = (
    Rule("pem", 2, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", 0, 1, "-----BEGIN "),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("url_login", 2, r"://[A-Za-z0-9._-]*+:[^\s@/:]{3,}+@", 0, 1, "://[A-Za-z0-9._-]*+:"),
    Rule("prefixed", 1, r"(?<![A-Za-z0-9_])(?:gh[oprsu]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}+", 0, 1,
         "gh[oprsu]_|glpat-|xox[abprs]-|sk_live_|AIza"),
)
LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:long,end:long>>"


def _found(rule: Rule, rank: int, text: Column, todo: Column) -> Column:
    may = F.array_contains(todo, rule.key)
    if rule.needs:
        may = may & text.rlike(rule.needs)
    spans = spans_if(may, text, rule.pattern, rule.part)
    held = F.filter(spans, lambda s: F.char_length(s["part"] if rule.part else s["match"]) >= rule.least)
    return F.transform(as_kind(held, rule.kind, rank), lambda s: F.struct(
        F.lit(rule.key).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def new_ledger(spark: SparkSession, path: str | None = None) -> str:
    """An empty ledger; without a path in the cluster's shared folder."""
    path = path or shared_path(spark, "secret-ledger")
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return path


def scan_unseen(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES, text: str = "text") -> DataFrame:
    """Scan every (blob, rule version) pair of ``docs`` that the ledger lacks; append it to the ledger.

    Returns the rows appended.  First names only: distinct blob names against the ledger.  The texts of
    unseen blobs then move once, one copy of each.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blobs = docs.select(F.sha2(body, 256).alias("blob"), body.alias("body"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    seen = (read_ledger(spark, ledger).select(F.col("blob").alias("_b"), F.explode("rules").alias("rule"))
            .groupBy("_b").agg(F.collect_set("rule").alias("done")))
    todo = (blobs.select("blob").distinct().join(seen, F.col("blob") == F.col("_b"), "left")
            .select(F.col("blob").alias("_t"), F.array_except(
                wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).filter("size(todo) > 0"))
    todo = stored(todo, "unseen")
    fresh = (blobs.groupBy("blob").agg(F.first("body").alias("body"))
             .join(todo, F.col("blob") == F.col("_t")))
    rows = fresh.select("blob", F.col("todo").alias("rules"), F.concat(
        *[_found(r, i, F.col("body"), F.col("todo")) for i, r in enumerate(rules)]).alias("found"))
    scanned = stored(rows, "scanned")
    scanned.write.mode("append").parquet(ledger)
    return scanned


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES, id_col: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per input row: id and ``found``, array<struct<start, rank, end, kind>> of the given rule versions."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    paths = docs.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("blob"))
    kind = F.create_map(*[x for i, r in enumerate(rules) for x in (
        F.lit(r.key), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind")))])
    # a redone append may repeat a row of the ledger: spans are a set
    known = (read_ledger(spark, ledger).filter(F.size("found") > 0)
             .select("blob", F.explode("found").alias("f")).filter(F.col("f.rule").isin([r.key for r in rules]))
             .groupBy("blob").agg(F.collect_set("f").alias("fs"))
             .select(F.col("blob").alias("_b"), F.transform("fs", lambda f: F.struct(
                 f["start"].alias("start"), kind[f["rule"]]["rank"].alias("rank"), f["end"].alias("end"),
                 kind[f["rule"]]["kind"].alias("kind"))).alias("found")))
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return (paths.join(known, F.col("blob") == F.col("_b"), "left")
            .select(F.col("id").alias(id_col), "blob", F.coalesce("found", none).alias("found")))


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Incremental scan, then one row per input row (id, blob, found).

    Null text is the empty blob; null ids and repeated rows are paths like any other; other columns
    are not read; an empty table scans nothing and gives no rows.
    """
    ledger = new_ledger(docs.sparkSession, ledger)
    scan_unseen(docs, ledger, rules, text)
    return findings(docs, ledger, rules, id_col, text)


def secret_report(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """scan_secrets as counts of the base kinds, digest of the base spans and list of all spans."""
    rows = scan_secrets(docs, ledger, id_col=id_col, text=text)
    base = [r.kind for r in BASE_RULES]
    counts = [count_kind(F.col("found"), k).alias(f"n_{k}") for k in base]
    return rows.select(id_col, *counts, F.sha2(span_list(F.filter("found", lambda s: s["kind"].isin(base))), 256)
                       .alias("base_sha256"), span_list(F.col("found")).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES,
           text: str = "text") -> DataFrame:
    """The documents, all columns, with every secret in the text replaced by its kind in brackets; null texts stay null."""
    ledger = new_ledger(docs.sparkSession, ledger)
    scan_unseen(docs, ledger, rules, text)
    blob, b, found = fresh_names(docs.columns, "blob", "b", "found")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = (read_ledger(docs.sparkSession, ledger).filter(F.size("found") > 0)
             .select(F.col("blob").alias(b), F.explode("found").alias("f"))
             .filter(F.col("f.rule").isin([r.key for r in rules]))
             .groupBy(b).agg(F.collect_set(F.struct(
                 F.col("f.start").alias("start"), F.col("f.end").alias("end"),
                 F.concat(F.lit("["), F.split_part("f.rule", F.lit("@"), F.lit(1)), F.lit("]")).alias("label"))).alias(found)))
    # texts with secrets only, written: few, and the planner knows their size
    known = stored(known, "findings")
    none = F.array().cast("array<struct<start:long,end:long,label:string>>")
    joined = docs.withColumn(blob, F.sha2(body, 256)).join(known, F.col(blob) == F.col(b), "left")
    clean = replace_spans(F.col(text), F.coalesce(found, none))
    return joined.select(*[F.when(F.col(text).isNotNull(), clean).alias(c) if c == text else F.col(c) for c in docs.columns])
