"""Column -> Column text functions (all JVM-side, no Python UDF).

Regex notes: patterns run on Java regex.  ``(?U)`` makes ``\\w \\s \\b``
Unicode-aware and ``(?d)`` lets ``.`` stop only at ``\\n``, which is how the
reviewed behaviour's patterns act.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve import rules

ColumnOrName = Column | str

# Line terminators as counted by str.splitlines: \r\n, \n, \r, \v, \f,
# \x1c-\x1e, \x85, U+2028, U+2029.  Same text works in Java regex and RE2.
LINE_TERM = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINE_TERM_AT_END = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]\z"
BASENAME = r"[^/]*\z"
# literal keyword that starts each function-name pattern, in pattern order
FN_KEYWORDS = ["function", "const", "def"]
EXTENSION = r"(?s)^\.*[^.].*(\.[^.]*)\z"
DIRNAME = r"(?s)^(.*)/"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def locate_from(sub: str, s: ColumnOrName, pos: Column) -> Column:
    """1-based position of ``sub`` in ``s`` at or after ``pos`` (0 if absent)."""
    return F.call_function("locate", F.lit(sub), _c(s), pos)


def normalize_newlines(content: ColumnOrName) -> Column:
    """Universal newlines: ``\\r\\n`` and ``\\r`` become ``\\n`` (S2 for tables)."""
    return F.regexp_replace(_c(content), r"\r\n?", "\n")


# single-character line terminators of str.splitlines (\r\n counts once)
_TERM_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def line_count(content: ColumnOrName) -> Column:
    """Number of lines with ``str.splitlines`` semantics.

    Terminator characters are counted by deleting them (``translate``, no
    regex) and each ``\r\n`` pair is counted once; a last line without a
    terminator adds one.
    """
    c = _c(content)
    n = F.length(c)
    singles = n - F.length(F.translate(c, _TERM_CHARS, ""))
    pairs = F.floor((n - F.length(F.replace(c, F.lit("\r\n"), F.lit("")))) / F.lit(2))
    last = F.substring(c, -1, 1)
    ends_with_term = F.call_function("instr", F.lit(_TERM_CHARS), last) > F.lit(0)
    trailing = F.when((n == F.lit(0)) | ends_with_term, F.lit(0)).otherwise(F.lit(1))
    return (singles - pairs + trailing).cast("bigint")


def basename(path: ColumnOrName) -> Column:
    return F.regexp_extract(_c(path), BASENAME, 0)


def dirname(path: ColumnOrName) -> Column:
    """Directory part of a relative path ('' for top-level files)."""
    return F.regexp_extract(_c(path), DIRNAME, 1)


def file_extension(path: ColumnOrName) -> Column:
    """``os.path.splitext`` extension: leading dots of the base name ignored."""
    return F.regexp_extract(basename(path), EXTENSION, 1)


def comment_prefix(path: ColumnOrName) -> Column:
    """``#`` when the lower-cased extension is ``.py``, else ``//``."""
    return F.when(F.lower(file_extension(path)) == F.lit(".py"), F.lit(rules.PY_COMMENT)).otherwise(
        F.lit(rules.OTHER_COMMENT))


def separator_prefix(path: ColumnOrName) -> Column:
    """Annotation separator prefix: case-sensitive ``endswith('.py')`` (K6)."""
    return F.when(_c(path).endswith(".py"), F.lit(rules.PY_COMMENT)).otherwise(F.lit(rules.OTHER_COMMENT))


def variant_seed(path: ColumnOrName) -> Column:
    """First 8 hex digits of md5(path) as an integer."""
    return F.conv(F.substring(F.md5(_c(path)), 1, 8), 16, 10).cast("bigint")


def review_text(path: ColumnOrName, content: ColumnOrName) -> Column:
    """lower(path || '\\n' || content): one lowered text serves hints and topics.

    No hint or topic key contains a newline, so a key found here is a key
    found in the lowered path or in the lowered content.
    """
    return F.lower(F.concat(_c(path), F.lit("\n"), _c(content)))


def any_contains(text: Column, keys: list[str]) -> Column:
    """OR of literal ``contains`` (keys are literals, never regexes)."""
    cond = F.lit(False)
    for k in keys:
        cond = cond | text.contains(k)
    return cond


def is_dsa(path: ColumnOrName, content: ColumnOrName, text: Column | None = None,
           lines: Column | None = None) -> Column:
    """DSA classification rule."""
    p, c = _c(path), _c(content)
    t = review_text(p, c) if text is None else text
    n = line_count(c) if lines is None else lines
    # the content part of t starts after lower(path) and the newline
    start = F.length(F.lower(p)) + F.lit(2)
    no_imports = F.lit(True)
    for m in rules.IMPORT_MARKERS:
        no_imports = no_imports & (locate_from(m, t, start) == F.lit(0))
    return any_contains(t, rules.DSA_HINTS) | (no_imports & (n < F.lit(rules.SHORT_FILE_LINES)))


def detect_topic(path: ColumnOrName, content: ColumnOrName, text: Column | None = None) -> Column:
    """First matching topic rule, else the default topic."""
    t = review_text(path, content) if text is None else text
    out = None
    for topic, keys in rules.TOPIC_RULES:
        cond = any_contains(t, keys)
        out = F.when(cond, F.lit(topic)) if out is None else out.when(cond, F.lit(topic))
    return out.otherwise(F.lit(rules.DEFAULT_TOPIC))


def _may_name(c: Column, keyword: str) -> Column:
    return c.contains(keyword) & c.contains("=>") if keyword == "const" else c.contains(keyword)


def _arrow_lines(c: Column) -> Column:
    """The text as far as arrow functions can be read from it, so that every start mark finds its arrow.

    ``const x = (`` looks for the next ``) =>`` of its line.  On a long line without one, each start mark
    would read the rest of the line again.  So start marks that hold a line feed are first brought onto
    a line of their own, and then every line is cut behind its last arrow; both are single passes, and
    no match is lost or added.
    """
    name, feed = r"([A-Za-z_]\w*+)", r"[^\S\n]*+\n\s*+"
    split_mark = (rf"(?U)const{feed}{name}\s*+=\s*+\(|const\s++{name}{feed}=\s*+\(|const\s++{name}\s*+={feed}\(")
    marks = F.regexp_replace(c, split_mark, "\nconst $1$2$3=(")
    return F.regexp_replace(marks, r"(?dU)(.*\)\s*=>)|.+", "$1")


def function_names(content: ColumnOrName) -> Column:
    """Up to three function names, patterns in order, first occurrence kept (T4)."""
    c = _c(content)
    empty = F.array().cast("array<string>")
    # a pattern can only match where its leading keyword occurs: a literal scan skips the regex
    parts = [F.when(_may_name(c, kw), F.regexp_extract_all(_arrow_lines(c) if kw == "const" else c, F.lit("(?dU)" + p),
                                                           F.lit(1))).otherwise(empty)
             for kw, p in zip(FN_KEYWORDS, rules.FN_NAME_PATTERNS)]
    return F.when(c.isNotNull(), F.slice(F.array_distinct(F.concat(*parts)), 1, rules.MAX_FN_NAMES))


def loop_count(content: ColumnOrName) -> Column:
    """Number of whole-word ``for`` (T5)."""
    c = _c(content)
    return F.when(c.contains("for"), F.regexp_count(c, F.lit("(?U)" + rules.LOOP_PATTERN))) \
        .when(c.isNotNull(), F.lit(0)).cast("bigint")


def has_nested_loops(content: ColumnOrName) -> Column:
    """Same truth value as a search for ``for[^{]*\\{[\\s\\S]*for``.

    Take the first ``for``; the first ``{`` after it; then any ``for``
    after that brace.  Three linear scans instead of a backtracking regex.
    """
    c = _c(content)
    i = F.locate("for", c)
    j = locate_from("{", c, i + F.lit(3))
    k = locate_from("for", c, j + F.lit(1))
    return (i > F.lit(0)) & (j > F.lit(0)) & (k > F.lit(0))


def has_recursion(content: ColumnOrName, names: Column | None = None) -> Column:
    """A name is called again after its first occurrence.

    The (at most three) names are unrolled instead of a lambda, so the
    projection stays inside whole-stage codegen.
    """
    c = _c(content)
    fns = function_names(c) if names is None else names
    out = F.lit(False)
    for i in range(rules.MAX_FN_NAMES):
        n = F.get(fns, i)
        after = F.call_function("substr", c, F.call_function("locate", n, c) + F.length(n))
        # names are \w+ identifiers, so they are safe inside the pattern
        called = F.regexp_like(after, F.concat(F.lit(r"(?U)\b"), n, F.lit(r"\s*\(")))
        out = out | F.coalesce(n.isNotNull() & called, F.lit(False))
    return out


def complexity_hints(recursion: Column, nested: Column, loops: Column) -> Column:
    """Hint sentence for the DSA feedback."""
    loop_part = F.when(nested, F.lit(rules.HINT_NESTED)).when(loops >= F.lit(1), F.lit(rules.HINT_LOOP))
    joined = F.concat_ws(rules.HINT_SEP, F.when(recursion, F.lit(rules.HINT_RECURSION)), loop_part)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(rules.HINT_NONE))


def function_label(names: Column) -> Column:
    """`` (e.g., a, b)`` or ``''`` for the general question pool."""
    return F.when(F.size(names) > F.lit(0), F.concat(F.lit(" (e.g., "), F.array_join(names, ", "), F.lit(")"))) \
        .otherwise(F.lit(""))


def iso_timestamp(ts: ColumnOrName) -> Column:
    """``datetime.isoformat()`` text: microseconds only when non-zero."""
    t = _c(ts)
    micros = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros == F.lit("000000"), F.lit("")).otherwise(F.concat(F.lit("."), micros)))


# characters that str.strip() removes
STRIPPED = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
            + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(s: ColumnOrName) -> Column:
    """Python ``str.strip()``: its white space at both ends, found from the ends inwards."""
    return F.btrim(_c(s), F.lit(STRIPPED))
