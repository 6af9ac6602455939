"""Places of pattern matches in a text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 1000


def let(value: Column, then) -> Column:
    """``then(value)`` with value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs.

    Summed in chunks, whose totals are then summed, so a long array costs n * _CHUNK and
    not n * n copied entries.
    """
    def sums(a: Column) -> Column:
        empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
        return F.aggregate(a, empty, lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")))

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")),
                             lambda i: sums(F.slice(v, i * _CHUNK + 1, F.lit(_CHUNK))))
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<array<long>>").alias("all"))
        added = F.aggregate(chunks, zero, lambda acc, c: F.struct(
            (acc["sum"] + c["sum"]).alias("sum"),
            F.concat(acc["all"], F.array(F.transform(c["all"], lambda x: x + acc["sum"]))).alias("all")))
        return F.when(F.size(v) > 0, F.flatten(added["all"])).otherwise(F.array().cast("array<long>"))

    return let(values, chunked)


def match_spans(text: Column, pattern: str, part: int = 0) -> Column:
    """array<struct<start, end, match, part, before, after>> of all leftmost non-overlapping matches, in code points.

    ``part`` is the group kept beside the whole match; before and after are the texts up to the
    neighbouring matches.  Java's ``split`` gives the text between the matches, so a match starts
    after all that was split off or matched before it.  The pattern never matches the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else F.lit(None).cast("array<string>")

    def placed(x: Column) -> Column:
        zipped = F.arrays_zip(x["between"].alias("b"), x["found"].alias("m"))
        step = F.transform(F.slice(zipped, 1, F.size(x["found"])),
                           lambda z: (F.char_length(z["b"]) + F.char_length(z["m"])).cast("long"))
        ends = running_sums(step)
        return let(ends, lambda e: F.transform(x["found"], lambda m, i: F.struct(
            (F.get(e, i) - F.char_length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("match"),
            F.get(x["kept"], i).alias("part"), F.get(x["between"], i).alias("before"),
            F.get(x["between"], i + 1).alias("after"))))

    return let(F.struct(found.alias("found"), kept.alias("kept"), F.split(text, pattern, -1).alias("between")), placed)


NO_SPANS = "array<struct<start:long,end:long,match:string,part:string,before:string,after:string>>"


def spans_if(condition: Column, text: Column, pattern: str, part: int = 0) -> Column:
    """``match_spans`` of the texts that meet a cheap necessary condition; none for the others."""
    return F.when(condition, match_spans(text, pattern, part)).otherwise(F.array().cast(NO_SPANS))


def span_list(spans: Column) -> Column:
    """array<struct<start, rank, kind, end, ...>> -> "kind:start:end,..." by start, then rank, then end."""
    return F.array_join(F.transform(F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def as_kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind"), s["match"].alias("match")))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with spans (array<struct<start, end, label>>, any order, overlaps allowed) replaced by their labels.

    Overlapping spans become one, under the label of the one that starts first.  The text is cut once into pieces of
    ``_PIECE`` characters, each span's text is taken from its pieces, and the parts are joined once at the end, so a
    text with many spans costs its length and not its length for each span.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                               s["label"].alias("label"))))

    def walk(part: Column) -> Column:
        """Spans of one run of the order -> its joined spans, and where they reach."""
        empty = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast(_JOINED).alias("all"))
        return F.aggregate(part, empty, lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(s["start"] < acc["end"], F.concat(F.slice(acc["all"], 1, F.size(acc["all"]) - 1), F.array(F.struct(
                F.element_at(acc["all"], -1)["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"),
                F.element_at(acc["all"], -1)["label"].alias("label")))))
            .otherwise(F.concat(acc["all"], F.array(s))).alias("all")))

    def cut(x: Column) -> Column:
        pieces, n = x["pieces"], x["n"]

        def between(lo: Column, hi: Column) -> Column:
            first, last = F.floor(lo / _PIECE).cast("int"), F.floor((hi - 1) / _PIECE).cast("int")
            joined = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.when(hi > lo, F.substring(joined, (lo - first * _PIECE + 1).cast("int"), (hi - lo).cast("int"))).otherwise(F.lit(""))

        # the text before each span and its label, then what follows the last one
        parts = F.transform(x["spans"], lambda s, i: F.concat(
            between(F.when(i > 0, F.get(x["spans"], i - 1)["end"]).otherwise(F.lit(0).cast("long")), F.least(s["start"], n)), s["label"]))
        return F.concat(F.array_join(parts, ""), between(F.element_at(x["spans"], -1)["end"], n))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(pieces.alias("pieces"), F.char_length(text).cast("long").alias("n"),
                                                  _disjoint(order, walk).alias("spans")), cut)).otherwise(text)


_PIECE = 4096
_JOINED = "array<struct<start:long,end:long,label:string>>"


def _disjoint(order: Column, walk) -> Column:
    """Sorted spans -> disjoint ones: runs of ``_CHUNK`` spans by themselves, then the runs' results one after the other."""
    def chunked(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")),
                           lambda i: walk(F.slice(v, i * _CHUNK + 1, F.lit(_CHUNK)))["all"])
        # a run's first spans may lie inside what the runs before it reach: those are cut off or shortened at the seam
        zero = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast(f"array<{_JOINED}>").alias("all"))
        added = F.aggregate(runs, zero, lambda acc, r: F.struct(
            F.greatest(acc["end"], F.array_max(F.transform(r, lambda s: s["end"]))).alias("end"),
            F.concat(acc["all"], F.array(F.filter(F.transform(r, lambda s: F.struct(
                F.greatest(s["start"], acc["end"]).alias("start"), F.greatest(s["end"], acc["end"]).alias("end"),
                F.when(s["start"] < acc["end"], F.lit("")).otherwise(s["label"]).alias("label"))),
                lambda s: s["end"] > s["start"]))).alias("all")))
        return F.flatten(added["all"])

    return let(order, chunked)
