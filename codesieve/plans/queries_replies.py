"""Registered queries for model prompts and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesieve import rules
from codesieve.operators import feedback as fb
from codesieve.plans import oracle as sq
from codesieve.plans.registry import FILE_KEYS, oracle_query, spark_query
from codesieve.plans.fixtures import Fixtures, duckdb_with


@spark_query("build_prompts")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return fb.build_prompts(fx.view("files_v")).select(*FILE_KEYS, "path", "prompt")


@oracle_query("build_prompts")
def build_prompts_sql() -> str:
    body = (f"SELECT {', '.join(FILE_KEYS)}, path, {sq.q(rules.PROMPT_HEAD + chr(10) + chr(10) + 'File path: ')} "
            f"|| path || {sq.q(chr(10) + chr(10) + 'Content:' + chr(10))} || substr(content, 1, {rules.PROMPT_CHAR_CAP}) "
            f"|| {sq.q(chr(10) + chr(10) + rules.PROMPT_TAIL)} AS prompt FROM files_v")
    return duckdb_with(body, ["files_v"])


def _parsed_sql(src: str) -> str:
    def last(key: str, missing: str) -> str:
        # the values of the view are strings without escapes, or null
        found = f"regexp_extract_all(span, '\"{key}\": (\"[^\"]*\"|null)', 1)[-1]"
        return sq.strip_ws(f"(CASE WHEN {found} = 'null' THEN 'None' ELSE coalesce(trim({found}, '\"'), '{missing}') END)")

    label = f"CASE WHEN starts_with(lower({last('classification', 'development')}), 'dsa') THEN 'DSA' ELSE 'development' END"
    return (f"SELECT * EXCLUDE (j, span), j IS NOT NULL AS usable, CASE WHEN j IS NOT NULL THEN {label} END "
            f"AS reply_classification, CASE WHEN j IS NOT NULL THEN {last('feedback', '')} END AS reply_feedback "
            f"FROM (SELECT *, try_cast(span AS JSON) AS j FROM (SELECT *, regexp_extract(reply, '(?s)\\{{.*\\}}', 0) AS span FROM ({src}) r0) r1) r2")


@spark_query("parse_replies")
def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    return fb.parse_replies(fx.view("replies_v")).select("conv_id", "turn", "usable", "reply_classification",
                                                         "reply_feedback")


@oracle_query("parse_replies")
def parse_replies_sql() -> str:
    body = (f"SELECT conv_id, turn, usable, reply_classification, reply_feedback "
            f"FROM ({_parsed_sql('SELECT * FROM replies_v')}) p")
    return duckdb_with(body, ["replies_v"])


@spark_query("review_with_replies")
def review_with_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixtures(spark, sf_dir)
    files = fx.files().select("repo_url", "path", "content")
    return fb.review_with_replies(files, fx.view("file_replies_v"), ["repo_url", "path"], order=["turn"])


@oracle_query("review_with_replies")
def review_with_replies_sql() -> str:
    rv = sq.review_files("SELECT repo_url, path, content FROM files_v", ["repo_url"])
    parsed = (f"SELECT repo_url, path, reply_classification, reply_feedback FROM ({_parsed_sql('SELECT * FROM file_replies_v')}) p "
              f"WHERE usable QUALIFY row_number() OVER (PARTITION BY repo_url, path "
              f"ORDER BY turn DESC, reply_classification DESC, reply_feedback DESC) = 1")
    body = (f"SELECT r.repo_url, r.path, coalesce(p.reply_classification, r.classification) AS classification, "
            f"CASE WHEN p.reply_classification IS NOT NULL THEN p.reply_feedback ELSE r.feedback END AS feedback, "
            f"CASE WHEN p.reply_classification IS NOT NULL THEN 'reply' ELSE 'rules' END AS source "
            f"FROM ({rv}) r LEFT JOIN ({parsed}) p ON p.repo_url = r.repo_url AND p.path = r.path")
    return duckdb_with(body, ["files_v", "file_replies_v"])
