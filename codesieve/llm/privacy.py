"""Personal data: base patterns, and terms that reveal a protected entity.  DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers found in the
texts.  A term is a word of four or more letters.  Its occurrences within ``window`` characters
of a mention of an entity are counted against all its occurrences in the corpus.  With N terms in
the corpus, w(e) of them near entity e, n(t) occurrences of term t, n(t, e) of them near e:

    information of e    IC(e)     = log2(N / w(e))
    disclosed by t      PMI(t; e) = log2(N * n(t, e) / (n(t) * w(e)))

The ratio PMI / IC is 1 for a term that only ever stands near e.  A term at or above
``generalise`` is replaced by its class, one at or above ``remove`` goes, at every place where it
stands in any text, near the entity or not.  ``support`` is the least n(t, e).  All counts cover
all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import fresh_names, stored
from codesieve.llm.spans import as_kind, count_kind, let, match_spans, replace_spans, span_list, spans_if

# A match starts at the start of a run or where the match before it ended, as it would if every
# place were tried; possessive repeats give the same matches without going back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term_remove", "term_generalise")

TERM = r"(?<![^\s\"'(\[])\p{L}{4,}+(?=[.,;:!?\"')\]]*+(?:\s|\z))"
WINDOW_CHARS = 100
SUPPORT = 3
GENERALISE = 0.9
REMOVE = 0.975


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The valid matches of each kind, array<struct<start, end, match, part, before, after>>."""
    email = spans_if(F.contains(text, F.lit("@")), text, EMAIL)
    ip = F.filter(spans_if(text.rlike(r"[0-9]\.[0-9]"), text, IP),
                  lambda s: s["match"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    card = F.filter(spans_if(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), text, CARD),
                    lambda s: F.char_length(_digits(s["match"])).between(12, 19) & F.call_function("luhn_check", _digits(s["match"])))
    phone = F.filter(spans_if(F.contains(text, F.lit("+")), text, PHONE),
                     lambda s: F.char_length(_digits(s["match"])).between(9, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _entity(kind: str, match: Column) -> Column:
    """A name for the protected value that does not hold the value itself."""
    value = F.lower(match) if kind == "email" else match if kind == "ip" else _digits(match)
    return F.md5(F.concat(F.lit(kind + ":"), value))


def _chunks(text: Column, size: int) -> Column:
    """The text cut into pieces of ``size`` characters, so that a place in a long text is found without walking to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _cut(chunks: Column, size: int, start: Column, length: Column) -> Column:
    """``length`` characters (at most ``size``) from place ``start`` on."""
    i = F.floor(start / size).cast("int")
    piece = F.concat(F.coalesce(F.get(chunks, i), F.lit("")), F.coalesce(F.get(chunks, i + 1), F.lit("")))
    return F.substring(piece, (start - i * size + 1).cast("int"), length.cast("int"))


def _near(kind: str, spans: Column, window: int) -> Column:
    """array<struct<entity, term, start, end>> of the terms within ``window`` characters of each mention.

    A word that the window cuts is left out.  A term never overlaps a span: it stands between white
    space, quotes or brackets, and no span holds such a word.
    """
    def around(s: Column) -> Column:
        # one character more than the window tells whether its outermost word is whole
        left = F.when(F.char_length(s["before"]) > window, F.regexp_replace(s["before"], r"^\S*", "")).otherwise(s["before"])
        right = F.when(F.char_length(s["after"]) > window, F.regexp_replace(s["after"], r"\S*$", "")).otherwise(s["after"])
        at = s["start"] - F.char_length(left)
        return F.transform(match_spans(F.concat(left, s["match"], right), TERM), lambda m: F.struct(
            _entity(kind, s["match"]).alias("entity"), F.lower(m["match"]).alias("term"),
            (at + m["start"]).alias("start"), (at + m["end"]).alias("end")))

    return F.flatten(F.transform(spans, around))


def find_base(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW_CHARS) -> DataFrame:
    """Rows (row, id, blob, base, near): base spans and the terms near them, one row per document, written once.

    ``row`` tells rows apart, also repeated ones; it is fixed by the written table.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    kinds = base_spans(F.col("body"))
    size = max(1000, window + 1)

    def placed(spans: Column) -> Column:
        def sides(chunks: Column) -> Column:
            def one(s: Column) -> Column:
                first = F.greatest(s["start"] - (window + 1), F.lit(0))
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
                                _cut(chunks, size, first, s["start"] - first).alias("before"),
                                _cut(chunks, size, s["end"], F.lit(window + 1)).alias("after"))
            return F.transform(spans, one)
        return let(F.when(F.size(spans) > 0, _chunks(F.col("body"), size)).otherwise(F.array().cast("array<string>")), sides)

    # written before the windows are searched, so that each pattern runs once over a text
    spans = stored(found.select("id", F.sha2("body", 256).alias("blob"), F.monotonically_increasing_id().alias("row"), *[
        let(c, placed).alias(k) for k, c in kinds.items()]), "base")
    base = F.concat(*[as_kind(F.col(k), k, i) for i, k in enumerate(KINDS)])
    near = F.concat(*[_near(k, F.col(k), window) for k in KINDS])
    return spans.select("row", "id", "blob", F.transform(base, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("base"),
        near.alias("near"))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) over all documents."""
    words = F.regexp_extract_all(F.col(text).cast("string"), F.lit(TERM), F.lit(0))
    return docs.select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def disclosures(near: DataFrame, counts: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """near (row, entity, term, start, end; distinct), counts (term, n) -> (entity, term, ratio) at or above ``least``."""
    counts = stored(counts, "terms")
    total = counts.agg(F.sum("n")).first()[0] or 0
    pairs = stored(near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")), "pairs")
    around = pairs.groupBy("entity").agg(F.sum("both").alias("w"))
    information = F.log2(F.lit(float(total)) / F.col("w"))
    ratio = F.when(information > 0, 1 + F.log2(F.least(F.col("both") / F.col("n"), F.lit(1.0))) / information).otherwise(F.lit(0.0))
    return (pairs.filter(F.col("both") >= support).join(around, "entity").join(counts, "term")
            .select("entity", "term", ratio.alias("ratio")).filter(F.col("ratio") >= least))


def term_places(docs: DataFrame, told: DataFrame, text: str = "text") -> DataFrame:
    """told (term, ratio) -> (blob, start, end, ratio) of every occurrence in any text; the blob is the text's SHA-256.

    The distinct terms of all texts are joined first; places are worked out in the texts that hold one.
    A common term or a repeated text is a skewed key of one side only, which AQE splits.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.sha2(body, 256).alias("blob"), body.alias("body"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(TERM), F.lit(0)), F.lower))
    hits = stored(texts.select("blob", F.explode(words).alias("term")).join(told, "term").distinct(), "hits")
    places = F.transform(match_spans(F.col("body"), TERM), lambda m: F.struct(
        F.lower(m["match"]).alias("term"), m["start"].alias("start"), m["end"].alias("end")))
    return (texts.join(hits.select("blob").distinct(), "blob", "left_semi").select("blob", F.explode(places).alias("p"))
            .select("blob", "p.*").join(hits, ["blob", "term"]).select("blob", "start", "end", "ratio").distinct())


def private_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW_CHARS,
                  support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per input row: id, blob (SHA-256 of the text), spans array<struct<start, rank, end, kind>>.

    Null text counts as empty; null ids and repeated rows are documents like any other, and count as
    such; other columns are not read; an empty table gives no rows.
    """
    base = stored(find_base(docs, id_col, text, window), "near")
    # a word between two mentions of one entity is one occurrence
    near = stored(base.select("row", F.explode("near").alias("x")).select("row", "x.*").distinct(), "occurrences")
    told = disclosures(near, term_counts(docs, text), support, generalise)
    told = stored(told.groupBy("term").agg(F.max("ratio").alias("ratio")), "disclosing")
    spans = (term_places(docs, told, text)
             .select("blob", F.struct(
                 "start", F.lit(len(KINDS)).alias("rank"), "end",
                 F.when(F.col("ratio") >= remove, TERM_KINDS[0]).otherwise(TERM_KINDS[1]).alias("kind")).alias("s"))
             .groupBy("blob").agg(F.collect_list("s").alias("terms")).withColumnRenamed("blob", "_blob"))
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return (base.select("id", "blob", "base").join(spans, F.col("blob") == F.col("_blob"), "left")
            .select(F.col("id").alias(id_col), "blob", F.concat("base", F.coalesce("terms", none)).alias("spans")))


def private_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """private_spans as counts of the base kinds, digest of the base spans and list of all spans."""
    rows = private_spans(docs, id_col, text)
    base = F.filter("spans", lambda s: s["kind"].isin(list(KINDS)))
    return rows.select(id_col, *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns: base spans and generalised terms replaced by their class, removed terms cut out.

    Equal texts get equal spans, so spans are joined back by the text's SHA-256, one row for each text.
    """
    blob, b, found = fresh_names(docs.columns, "blob", "b", "found")
    label = F.create_map(*[F.lit(x) for k in KINDS for x in (k, f"[{k}]")], F.lit(TERM_KINDS[0]), F.lit(""),
                         F.lit(TERM_KINDS[1]), F.lit("[term]"))
    known = (private_spans(docs, id_col, text, **options).filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("s"))
             .select(F.col("blob").alias(b), F.transform("s", lambda s: F.struct(
                 s["start"].alias("start"), s["end"].alias("end"), label[s["kind"]].alias("label"))).alias(found)))
    none = F.array().cast("array<struct<start:long,end:long,label:string>>")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    joined = docs.withColumn(blob, F.sha2(body, 256)).join(known, F.col(blob) == F.col(b), "left")
    clean = replace_spans(F.col(text), F.coalesce(found, none))
    return joined.select(*[F.when(F.col(text).isNotNull(), clean).alias(c) if c == text else F.col(c) for c in docs.columns])
