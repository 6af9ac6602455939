"""Registered queries: a Spark DataFrame builder and a DuckDB oracle per name.

Each Spark builder takes (spark, sf_dir) and reads the driver tables of
that directory through the derived views of :mod:`codesieve.plans.fixtures`.
Each oracle is one DuckDB statement over the driver views, built by the
independent SQL writer in :mod:`codesieve.plans.oracle`.  Column names and
types (BIGINT for counts and ids) agree between the two.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.functions import text as tx
from codesieve.functions import urls
from codesieve.operators import feedback as fb
from codesieve.plans import oracle as sq
from codesieve.plans.fixtures import Fixtures, duckdb_with

from codesieve.plans.registry import FILE_KEYS, ORACLE, SPARK, QueryFn, oracle_query, spark_query  # noqa: F401


def _files(spark: SparkSession, sf_dir: str) -> tuple[Fixtures, DataFrame]:
    fx = Fixtures(spark, sf_dir)
    return fx, fx.files()


# ---------------------------------------------------------------------------
# Flagship and rule operators
# ---------------------------------------------------------------------------

@spark_query("review_files")
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    return fb.review_files(files, keys=FILE_KEYS)


@oracle_query("review_files")
def review_files_sql() -> str:
    return duckdb_with(sq.review_files("SELECT * FROM files_v", FILE_KEYS), ["files_v"])


@spark_query("classify_files")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    dsa = tx.is_dsa("path", "content")
    return files.select(*FILE_KEYS, "path", F.when(dsa, F.lit(rules.DSA)).otherwise(F.lit(rules.DEVELOPMENT))
                        .alias("classification"))


@oracle_query("classify_files")
def classify_files_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, {sq.classification()} AS classification "
            f"FROM ({sq.analyze('SELECT * FROM files_v')}) a")
    return duckdb_with(body, ["files_v"])


@spark_query("detect_topic")
def detect_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    return files.select(*FILE_KEYS, "path", tx.detect_topic("path", "content").alias("topic"))


@oracle_query("detect_topic")
def detect_topic_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, {sq.topic('lower(path || chr(10) || content)')} AS topic "
            f"FROM files_v")
    return duckdb_with(body, ["files_v"])


@spark_query("variant_seed")
def variant_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    return files.select(*FILE_KEYS, "path", tx.variant_seed("path").alias("seed"),
                        F.pmod(tx.variant_seed("path"), F.lit(2)).cast("bigint").alias("variant"))


@oracle_query("variant_seed")
def variant_seed_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, {sq.seed('path')} AS seed, "
            f"({sq.seed('path')} % 2)::BIGINT AS variant FROM files_v")
    return duckdb_with(body, ["files_v"])


@spark_query("question_lookup")
def question_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    # one row per file; question columns are null for development files
    out = fb.with_questions(fb.analyze(files))
    return out.select(*FILE_KEYS, "path", "is_dsa", "topic", "pool_topic", "variant", "q_easy", "q_medium", "q_hard")


@oracle_query("question_lookup")
def question_lookup_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, is_dsa, topic, pool_topic, variant::BIGINT AS variant, q_easy, "
            f"q_medium, q_hard FROM ({sq.with_questions(sq.analyze('SELECT * FROM files_v'))}) x")
    return duckdb_with(body, ["files_v"])


@spark_query("dsa_feedback")
def dsa_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    # one row per file; the DSA text is null for development files
    out = fb.with_questions(fb.analyze(files))
    return out.select(*FILE_KEYS, "path", "is_dsa", F.when(F.col("is_dsa"), fb.feedback_column()).alias("feedback"))


@oracle_query("dsa_feedback")
def dsa_feedback_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, is_dsa, CASE WHEN is_dsa THEN {sq.dsa_text()} END AS feedback "
            f"FROM ({sq.with_questions(sq.analyze('SELECT * FROM files_v'))}) x")
    return duckdb_with(body, ["files_v"])


@spark_query("dev_feedback")
def dev_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    # one row per file; the development text is null for DSA files
    out = fb.analyze(files)
    return out.select(*FILE_KEYS, "path", "is_dsa", F.when(~F.col("is_dsa"), fb.dev_feedback_column()).alias("feedback"))


@oracle_query("dev_feedback")
def dev_feedback_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, is_dsa, CASE WHEN NOT is_dsa THEN {sq.dev_text()} END AS feedback "
            f"FROM ({sq.analyze('SELECT * FROM files_v')}) x")
    return duckdb_with(body, ["files_v"])


@spark_query("line_count")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    return files.select(*FILE_KEYS, "path", tx.line_count("content").alias("lines"))


@oracle_query("line_count")
def line_count_sql() -> str:
    return duckdb_with(f"SELECT {', '.join(FILE_KEYS)}, path, {sq.line_count('content')} AS lines FROM files_v",
                       ["files_v"])


@spark_query("file_extension")
def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    return files.select(*FILE_KEYS, "path", tx.file_extension("path").alias("ext"))


@oracle_query("file_extension")
def file_extension_sql() -> str:
    return duckdb_with(f"SELECT {', '.join(FILE_KEYS)}, path, {sq.ext('path')} AS ext FROM files_v", ["files_v"])


@spark_query("comment_prefix")
def comment_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    return files.select(*FILE_KEYS, "path", tx.comment_prefix("path").alias("prefix"),
                        tx.separator_prefix("path").alias("separator_prefix"))


@oracle_query("comment_prefix")
def comment_prefix_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, {sq.prefix('path')} AS prefix, "
            f"CASE WHEN ends_with(path, '.py') THEN '#' ELSE '//' END AS separator_prefix FROM files_v")
    return duckdb_with(body, ["files_v"])


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = _files(spark, sf_dir)
    names = tx.function_names("content")
    staged = files.select(*FILE_KEYS, "path", "content", names.alias("fn_names"))
    return staged.select(
        *FILE_KEYS, "path", "fn_names",
        tx.loop_count("content").alias("loops"),
        tx.has_nested_loops("content").alias("nested"),
        tx.has_recursion("content", F.col("fn_names")).alias("recursive"))


def _structure_sql(cols: str) -> str:
    return duckdb_with(f"SELECT {', '.join(FILE_KEYS)}, path, {cols} FROM ({sq.structure('SELECT * FROM files_v')}) s",
                       ["files_v"])


@spark_query("function_names")
def function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).select(*FILE_KEYS, "path", F.array_join("fn_names", ",").alias("fn_names"),
                                            F.size("fn_names").cast("bigint").alias("n_names"))


@oracle_query("function_names")
def function_names_sql() -> str:
    return _structure_sql("array_to_string(fn_names, ',') AS fn_names, len(fn_names)::BIGINT AS n_names")


@spark_query("loop_count")
def loop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).select(*FILE_KEYS, "path", "loops")


@oracle_query("loop_count")
def loop_count_sql() -> str:
    return _structure_sql("loops")


@spark_query("nested_loops")
def nested_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).select(*FILE_KEYS, "path", "nested")


@oracle_query("nested_loops")
def nested_loops_sql() -> str:
    return _structure_sql("nested")


@spark_query("recursion_flag")
def recursion_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir).select(*FILE_KEYS, "path", "recursive")


@oracle_query("recursion_flag")
def recursion_flag_sql() -> str:
    return _structure_sql("recursive")


@spark_query("complexity_hints")
def complexity_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structure(spark, sf_dir)
    return s.select(*FILE_KEYS, "path", tx.complexity_hints(F.col("recursive"), F.col("nested"), F.col("loops"))
                    .alias("hints"))


@oracle_query("complexity_hints")
def complexity_hints_sql() -> str:
    return _structure_sql("hints")


@spark_query("parse_repo_url")
def parse_repo_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    parsed = fx.view("urls_v").select("id", "url", urls.parse_repo_url("url").alias("p"))
    return parsed.select(F.col("id").cast("bigint").alias("id"), "url", F.col("p.owner").alias("owner"),
                         F.col("p.name").alias("name"), F.col("p.owner").isNotNull().alias("valid"),
                         F.when(F.col("p.owner").isNotNull(), urls.local_key("p.owner", "p.name")).alias("local_key"))


@oracle_query("parse_repo_url")
def parse_repo_url_sql() -> str:
    body = ("SELECT id::BIGINT AS id, url, owner, name, valid, CASE WHEN valid THEN owner || '__' || name END "
            f"AS local_key FROM ({sq.parse_urls('SELECT id, url FROM urls_v')}) p")
    return duckdb_with(body, ["urls_v"])


def all_queries() -> dict[str, QueryFn]:
    return dict(SPARK)


def all_oracles() -> dict[str, str]:
    return {k: fn() for k, fn in ORACLE.items()}


def _load_all() -> None:
    from codesieve.plans import queries_select  # noqa: F401
    from codesieve.plans import queries_store  # noqa: F401
    from codesieve.plans import queries_replies  # noqa: F401


_load_all()
