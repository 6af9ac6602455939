"""Per-file review: classification, topic, hints, question lookup, feedback text.

All work is a projection over the files DataFrame plus one join with the
question bank.  The bank's size is known to the planner, which broadcasts a
small one (the default) by its own threshold; then the review runs inside the
scan's stages whatever the size of the files table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesieve import rules
from codesieve.functions import text as tx

BANK_SCHEMA = T.StructType([
    T.StructField("pool_topic", T.StringType(), False),
    T.StructField("variant", T.LongType(), False),
    T.StructField("q_easy", T.StringType(), False),
    T.StructField("q_medium", T.StringType(), False),
    T.StructField("q_hard", T.StringType(), False),
])


def question_bank(spark: SparkSession, bank: dict | None = None) -> DataFrame:
    """Question bank dimension (topic, variant, easy, medium, hard): a table of literals, so the planner knows its size."""
    bank = rules.QUESTION_BANK if bank is None else bank
    rows = [(t, i, e, m, h) for t, pool in bank.items() for i, (e, m, h) in enumerate(pool)]
    if not rows:
        return spark.createDataFrame([], BANK_SCHEMA)
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({text(t)}, {i}L, {text(e)}, {text(m)}, {text(h)})" for t, i, e, m, h in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS bank({', '.join(BANK_SCHEMA.names)})")


def _pool_key(topic: Column, bank: dict) -> tuple[Column, Column]:
    """(pool topic, pool size) for a detected topic; topics without a pool use the default pool."""
    pooled = [t for t in bank if t != rules.DEFAULT_TOPIC]
    key = F.when(topic.isin(pooled), topic).otherwise(F.lit(rules.DEFAULT_TOPIC))
    size = None
    for t, pool in bank.items():
        cond = key == F.lit(t)
        size = F.when(cond, F.lit(len(pool))) if size is None else size.when(cond, F.lit(len(pool)))
    return key, size.cast("bigint")


def analyze(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Add rule columns: ext, prefix, seed, is_dsa, topic, fn_names, loops, nested, recursive, hints.

    Structural columns (names, loops, recursion, hints) are computed only for
    DSA rows; the lowered text is one projected column reused by hints and topics.
    """
    p, c = F.col(path), F.col(content)
    # the line count is evaluated only for files no hint word marks as DSA (OR short-circuits)
    staged = df.withColumn("_text", tx.review_text(p, c))
    dsa = tx.is_dsa(p, c, text=F.col("_text"))
    staged = staged.withColumn("is_dsa", dsa)
    dsa_col = F.col("is_dsa")
    staged = (staged
              .withColumn("ext", tx.file_extension(p))
              .withColumn("prefix", tx.comment_prefix(p))
              .withColumn("seed", tx.variant_seed(p))
              .withColumn("topic", F.when(dsa_col, tx.detect_topic(p, c, text=F.col("_text"))))
              .withColumn("fn_names", F.when(dsa_col, tx.function_names(c)))
              .withColumn("loops", F.when(dsa_col, tx.loop_count(c)))
              .withColumn("nested", F.when(dsa_col, tx.has_nested_loops(c)))
              .withColumn("recursive", F.when(dsa_col, tx.has_recursion(c, F.col("fn_names"))))
              .withColumn("hints", F.when(dsa_col, tx.complexity_hints(
                  F.col("recursive"), F.col("nested"), F.col("loops"))))
              .drop("_text"))
    return staged


def _dsa_text(prefix: Column, topic: Column, hints: Column, names: Column,
              easy: Column, medium: Column, hard: Column) -> Column:
    label = tx.function_label(names)

    def q(col: Column) -> Column:
        return F.replace(col, F.lit(rules.FN_PLACEHOLDER), label)

    lines = [
        F.concat(prefix, F.lit(" DSA Review ("), topic, F.lit(")")),
        F.concat(prefix, F.lit(" Complexity hints: "), hints),
        F.concat(prefix, F.lit(" Easy: "), q(easy)),
        F.concat(prefix, F.lit(" Medium: "), q(medium)),
        F.concat(prefix, F.lit(" Hard: "), q(hard)),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def _dev_text(prefix: Column, ext: Column) -> Column:
    """Header and notes, one per line, each behind the comment prefix (no lambda: stays in codegen)."""
    def block(notes: list[str]) -> Column:
        lines = [F.concat(prefix, F.lit(" Development Review"))] + [F.concat(prefix, F.lit(" - " + n)) for n in notes]
        return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))

    js_like = F.lower(ext).isin(rules.JS_LIKE_EXTS)
    return F.when(js_like, block(rules.DEV_NOTES_COMMON + rules.DEV_NOTES_JS)) \
        .otherwise(block(rules.DEV_NOTES_COMMON + rules.DEV_NOTES_OTHER))


def with_questions(analyzed: DataFrame, bank: dict | None = None) -> DataFrame:
    """Attach easy/medium/hard by (pool topic, variant); topics without a pool use the default pool."""
    bank = rules.QUESTION_BANK if bank is None else bank
    spark = analyzed.sparkSession
    key, size = _pool_key(F.col("topic"), bank)
    keyed = (analyzed.withColumn("pool_topic", F.when(F.col("is_dsa"), key))
             .withColumn("variant", F.when(F.col("is_dsa"), F.pmod(F.col("seed"), size))))
    return keyed.join(question_bank(spark, bank), ["pool_topic", "variant"], "left")


def dev_feedback_column() -> Column:
    """T13 alone: development notes text (needs only prefix and ext)."""
    return _dev_text(F.col("prefix"), F.col("ext"))


def feedback_column() -> Column:
    """Feedback text by classification."""
    dsa = _dsa_text(F.col("prefix"), F.col("topic"), F.col("hints"), F.col("fn_names"),
                    F.col("q_easy"), F.col("q_medium"), F.col("q_hard"))
    return F.when(F.col("is_dsa"), dsa).otherwise(_dev_text(F.col("prefix"), F.col("ext")))


def classification_column() -> Column:
    return F.when(F.col("is_dsa"), F.lit(rules.DSA)).otherwise(F.lit(rules.DEVELOPMENT))


def review_files(files: DataFrame, keys: list[str] | None = None, bank: dict | None = None,
                 path: str = "path", content: str = "content", carry: list[str] | None = None) -> DataFrame:
    """Flagship: (keys..., path, classification, topic, feedback, carry...) for every file row.

    ``carry`` names input columns passed through unchanged (e.g. ``content``
    for annotation), so later steps need no join back to the files.
    """
    carry = carry or []
    keys = [k for k in (keys if keys is not None else files.columns) if k not in (path, content, *carry)]
    out = with_questions(analyze(files, path, content), bank)
    return out.select(*keys, F.col(path).alias("path"), classification_column().alias("classification"),
                      F.col("topic"), feedback_column().alias("feedback"), *carry)


# ---------------------------------------------------------------------------
# Model prompts and replies
# ---------------------------------------------------------------------------

def build_prompts(files: DataFrame, path: str = "path", content: str = "content",
                  char_cap: int = rules.PROMPT_CHAR_CAP) -> DataFrame:
    """Prompt text per file: instructions, path and the first ``char_cap`` characters."""
    prompt = F.concat(F.lit(rules.PROMPT_HEAD + "\n\nFile path: "), F.col(path), F.lit("\n\nContent:\n"),
                      F.substring(F.col(content), 1, char_cap), F.lit("\n\n" + rules.PROMPT_TAIL))
    return files.withColumn("prompt", prompt)


def reply_entries(reply: Column) -> Column:
    """array<struct<key, value>> of the reply's JSON object, in order and with repeated keys; null if not usable.

    The object is the greedy span from the first ``{`` to the last ``}``.  It is parsed as the only element of a list,
    so that anything but one whole object is refused: text after it, two objects, quotes that JSON does not have.
    """
    span = F.concat(F.lit("["), F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("]"))
    objects = F.from_json(span, "array<map<string,string>>", {"allowSingleQuotes": "false"})
    return F.when(F.size(objects) == 1, F.map_entries(F.get(objects, F.lit(0))))


def _last_value(entries: Column, key: str, missing: str) -> Column:
    """The last value under ``key``; ``missing`` without one, the text None for a JSON null."""
    last = F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))
    return F.when(last.isNull(), F.lit(missing)).otherwise(F.coalesce(last["value"], F.lit("None")))


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The rows with usable, reply_classification and reply_feedback (null where the reply is not usable).

    A missing classification means development, a missing feedback ''.  Of a repeated key the last value counts.
    Numbers, booleans, lists and objects become their JSON text, a null the text None.
    """
    entries, usable = F.col("_entries"), F.col("_entries").isNotNull()
    cls = tx.strip_ws(_last_value(entries, "classification", rules.DEVELOPMENT))
    label = F.when(F.lower(cls).startswith("dsa"), F.lit(rules.DSA)).otherwise(F.lit(rules.DEVELOPMENT))
    return replies.withColumn("_entries", reply_entries(F.col(reply))).select(
        *replies.columns, usable.alias("usable"), F.when(usable, label).alias("reply_classification"),
        F.when(usable, tx.strip_ws(_last_value(entries, "feedback", ""))).alias("reply_feedback"))


def review_with_replies(files: DataFrame, replies: DataFrame, keys: list[str],
                        bank: dict | None = None, carry: list[str] | None = None,
                        order: list[str] | None = None) -> DataFrame:
    """A usable reply wins; otherwise the rule-based review.  One row per file.

    Of several usable replies to one file the last by ``order`` (columns of
    ``replies``) counts, then by classification and text, so the result is
    the same on every run.  Replies are reduced per file key before the join.
    """
    carry = carry or []
    parsed = parse_replies(replies).where(F.col("usable"))
    last = F.max(F.struct(*(order or []), "reply_classification", "reply_feedback")).alias("_r")
    one = parsed.groupBy(*keys).agg(last).select(*keys, "_r.reply_classification", "_r.reply_feedback")
    reviewed = review_files(files, keys=keys, bank=bank, carry=carry)
    joined = reviewed.join(one, keys, "left")
    used = F.col("reply_classification").isNotNull()
    return joined.select(
        *[k for k in keys if k != "path"], "path",
        F.when(used, F.col("reply_classification")).otherwise(F.col("classification")).alias("classification"),
        F.when(used, F.col("reply_feedback")).otherwise(F.col("feedback")).alias("feedback"),
        F.when(used, F.lit("reply")).otherwise(F.lit("rules")).alias("source"),
        *carry,
    )


# ---------------------------------------------------------------------------
# Annotated copies (K6)
# ---------------------------------------------------------------------------

def annotation(path: Column, classification: Column, feedback: Column) -> Column:
    """Separator plus feedback with a guaranteed trailing newline."""
    sep = F.concat(F.lit("\n"), tx.separator_prefix(path), F.lit(" --- Auto Review ("), classification,
                   F.lit(") ---\n"))
    body = F.when(feedback.endswith("\n"), feedback).otherwise(F.concat(feedback, F.lit("\n")))
    return F.concat(sep, body)


def annotate_files(reviewed: DataFrame) -> DataFrame:
    """K6: patched file text = original content + annotation, on reviewed rows that carry ``content``.

    A ``raw`` binary column, when carried, keeps the original bytes and gets
    the UTF-8 annotation appended.  A projection: no join, no shuffle.
    """
    note = annotation(F.col("path"), F.col("classification"), F.col("feedback"))
    out = reviewed.withColumn("annotated", F.concat(F.col("content"), note))
    if "raw" in reviewed.columns:
        out = out.withColumn("annotated_raw", F.concat(F.col("raw"), F.encode(note, "UTF-8")))
    return out
