"""DuckDB SQL writer for the rule operators (the correctness oracle).

Written independently of the Spark column builders, from the same rule
data.  DuckDB's RE2 has ASCII ``\\w \\s \\b``; the Unicode behaviour of the
Spark side (Java ``(?U)``) is spelled out with explicit classes here.
"""

from __future__ import annotations

from codesieve import rules

W = r"[\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Me}\p{Pc}]"
NOT_W = r"[^\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}\p{Me}\p{Pc}]"
S = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
STRIPPED = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_TERM = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINE_TERM_AT_END = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]\z"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return pattern.replace(r"\w", W).replace(r"\s", S)


def any_contains(t: str, keys: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(k)})" for k in keys) + ")"


def line_count(c: str) -> str:
    return (f"(len(regexp_extract_all({c}, {q(LINE_TERM)})) + CASE WHEN {c} = '' OR "
            f"regexp_matches({c}, {q(LINE_TERM_AT_END)}) THEN 0 ELSE 1 END)::BIGINT")


def ext(path: str) -> str:
    base = f"regexp_extract({path}, {q(r'[^/]*\z')}, 0)"
    return f"regexp_extract({base}, {q(r'(?s)^\.*[^.].*(\.[^.]*)\z')}, 1)"


def prefix(path: str) -> str:
    return f"CASE WHEN lower({ext(path)}) = '.py' THEN '#' ELSE '//' END"


def seed(path: str) -> str:
    return f"('0x' || substr(md5({path}), 1, 8))::BIGINT"


def topic(t: str) -> str:
    arms = " ".join(f"WHEN {any_contains(t, keys)} THEN {q(name)}" for name, keys in rules.TOPIC_RULES)
    return f"CASE {arms} ELSE {q(rules.DEFAULT_TOPIC)} END"


def is_dsa(path: str, t: str, lines: str) -> str:
    tail = f"substr({t}, length(lower({path})) + 2)"
    no_imp = " AND ".join(f"strpos({tail}, {q(m)}) = 0" for m in rules.IMPORT_MARKERS)
    return f"({any_contains(t, rules.DSA_HINTS)} OR ({no_imp} AND {lines} < {rules.SHORT_FILE_LINES}))"


def fn_names(c: str) -> str:
    parts = [f"regexp_extract_all({c}, {q(re2(p))}, 1)" for p in rules.FN_NAME_PATTERNS]
    cat = parts[0]
    for p in parts[1:]:
        cat = f"list_concat({cat}, {p})"
    dedup = f"list_filter({cat}, lambda v, i: list_position({cat}, v) = i)"
    return f"list_slice({dedup}, 1, {rules.MAX_FN_NAMES})"


def loops(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, {q(NOT_W + '+')}), lambda w: w = 'for'))::BIGINT"


def find_from(c: str, sub: str, pos: str) -> str:
    """1-based position of sub in c at or after pos, 0 if absent (like Spark's locate)."""
    return (f"CASE WHEN strpos(substr({c}, {pos}), {q(sub)}) > 0 "
            f"THEN strpos(substr({c}, {pos}), {q(sub)}) + ({pos}) - 1 ELSE 0 END")


def recursive(c: str, names: str) -> str:
    pat = f"'(^|{NOT_W})' || n || {q(S + '*' + chr(92) + '(')}"
    return (f"(len(list_filter({names}, lambda n: regexp_matches(substr({c}, strpos({c}, n) + length(n)), "
            f"{pat}))) > 0)")


def hints(rec: str, nested: str, nloops: str) -> str:
    return (f"coalesce(nullif(concat_ws(', ', CASE WHEN {rec} THEN {q(rules.HINT_RECURSION)} END, "
            f"CASE WHEN {nested} THEN {q(rules.HINT_NESTED)} WHEN {nloops} >= 1 THEN {q(rules.HINT_LOOP)} END), ''), "
            f"{q(rules.HINT_NONE)})")


def iso(ts: str) -> str:
    return (f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({ts}, '%f') = '000000' THEN '' "
            f"ELSE '.' || strftime({ts}, '%f') END")


def strip_ws(s: str) -> str:
    return f"trim({s}, {q(STRIPPED)})"


def structure(src: str, c: str = "content") -> str:
    """All rows of src plus fn_names, loops, nested, recursive, hints."""
    l1 = f"SELECT *, {fn_names(c)} AS fn_names, {loops(c)} AS loops, strpos({c}, 'for') AS _i FROM ({src}) s1"
    l2 = f"SELECT *, CASE WHEN _i > 0 THEN {find_from(c, '{', '_i + 3')} ELSE 0 END AS _j FROM ({l1}) s2"
    l3 = (f"SELECT *, (_i > 0 AND _j > 0 AND {find_from(c, 'for', '_j + 1')} > 0) AS nested, "
          f"{recursive(c, 'fn_names')} AS recursive FROM ({l2}) s3")
    l4 = f"SELECT * EXCLUDE (_i, _j), {hints('recursive', 'nested', 'loops')} AS hints FROM ({l3}) s4"
    return l4


def analyze(src: str, path: str = "path", c: str = "content") -> str:
    """src plus lines, is_dsa, ext, prefix, seed, topic and structure columns (DSA rows only)."""
    l1 = f"SELECT *, lower({path} || chr(10) || {c}) AS _t, {line_count(c)} AS lines FROM ({src}) a1"
    l2 = (f"SELECT *, {is_dsa(path, '_t', 'lines')} AS is_dsa, {ext(path)} AS ext, {prefix(path)} AS prefix, "
          f"{seed(path)} AS seed, {topic('_t')} AS _topic FROM ({l1}) a2")
    l3 = structure(l2, c)
    return (f"SELECT * EXCLUDE (_t, _topic, fn_names, loops, nested, recursive, hints), "
            f"CASE WHEN is_dsa THEN _topic END AS topic, CASE WHEN is_dsa THEN fn_names END AS fn_names, "
            f"CASE WHEN is_dsa THEN loops END AS loops, CASE WHEN is_dsa THEN nested END AS nested, "
            f"CASE WHEN is_dsa THEN recursive END AS recursive, CASE WHEN is_dsa THEN hints END AS hints "
            f"FROM ({l3}) a3")


def bank_values(bank: dict | None = None) -> str:
    bank = rules.QUESTION_BANK if bank is None else bank
    rows = ", ".join(f"({q(t)}, {i}, {q(e)}, {q(m)}, {q(h)})"
                     for t, pool in bank.items() for i, (e, m, h) in enumerate(pool))
    return f"(SELECT * FROM (VALUES {rows}) AS b(pool_topic, variant, q_easy, q_medium, q_hard))"


def pool_key(topic_col: str, bank: dict | None = None) -> tuple[str, str]:
    bank = rules.QUESTION_BANK if bank is None else bank
    pooled = ", ".join(q(t) for t in bank if t != rules.DEFAULT_TOPIC)
    key = f"CASE WHEN {topic_col} IN ({pooled}) THEN {topic_col} ELSE {q(rules.DEFAULT_TOPIC)} END"
    size = "CASE " + " ".join(f"WHEN {key} = {q(t)} THEN {len(p)}" for t, p in bank.items()) + " END"
    return key, size


def with_questions(analyzed: str) -> str:
    key, size = pool_key("topic")
    keyed = (f"SELECT *, CASE WHEN is_dsa THEN {key} END AS pool_topic, "
             f"CASE WHEN is_dsa THEN seed % ({size}) END AS variant FROM ({analyzed}) w1")
    return (f"SELECT w2.*, b.q_easy, b.q_medium, b.q_hard FROM ({keyed}) w2 LEFT JOIN {bank_values()} b "
            f"ON w2.pool_topic = b.pool_topic AND w2.variant = b.variant")


def dsa_text() -> str:
    label = "CASE WHEN len(fn_names) > 0 THEN ' (e.g., ' || array_to_string(fn_names, ', ') || ')' ELSE '' END"

    def qq(col: str) -> str:
        return f"replace({col}, {q(rules.FN_PLACEHOLDER)}, {label})"

    nl = " || chr(10) || "
    lines = [
        "prefix || ' DSA Review (' || topic || ')'",
        "prefix || ' Complexity hints: ' || hints",
        f"prefix || ' Easy: ' || {qq('q_easy')}",
        f"prefix || ' Medium: ' || {qq('q_medium')}",
        f"prefix || ' Hard: ' || {qq('q_hard')}",
    ]
    return "(" + nl.join(lines) + " || chr(10))"


def dev_text() -> str:
    def block(notes: list[str]) -> str:
        parts = ["prefix || ' Development Review'"] + [f"prefix || ' - ' || {q(n)}" for n in notes]
        return " || chr(10) || ".join(parts) + " || chr(10)"

    js = ", ".join(q(e) for e in rules.JS_LIKE_EXTS)
    return (f"CASE WHEN lower(ext) IN ({js}) THEN {block(rules.DEV_NOTES_COMMON + rules.DEV_NOTES_JS)} "
            f"ELSE {block(rules.DEV_NOTES_COMMON + rules.DEV_NOTES_OTHER)} END")


def feedback() -> str:
    return f"CASE WHEN is_dsa THEN {dsa_text()} ELSE {dev_text()} END"


def classification() -> str:
    return f"CASE WHEN is_dsa THEN {q(rules.DSA)} ELSE {q(rules.DEVELOPMENT)} END"


def review_files(src: str, keys: list[str]) -> str:
    cols = ", ".join(keys + ["path", f"{classification()} AS classification", "topic", f"{feedback()} AS feedback"])
    return f"SELECT {cols} FROM ({with_questions(analyze(src))}) r"


# ---------------------------------------------------------------------------
# Snapshots, refs and selection
# ---------------------------------------------------------------------------

def code_file(path: str = "path") -> str:
    suffix = " OR ".join(f"ends_with({path}, {q(s)})" for s in rules.CODE_SUFFIXES)
    dirn = f"regexp_extract({path}, {q('(?s)^(.*)/')}, 1)"
    return f"(({suffix}) AND NOT contains('/' || {dirn}, {q(rules.VCS_DIR_MARKER)}))"


def resolve_head(refs: str, branch: str = rules.DEFAULT_BRANCH) -> str:
    want = f"max(CASE WHEN ref = {q(branch)} THEN snapshot_id END)"
    if branch == rules.DEFAULT_BRANCH:
        head = f"coalesce({want}, max(CASE WHEN ref = {q(rules.FALLBACK_BRANCH)} THEN snapshot_id END))"
    else:
        head = want
    return (f"SELECT repo_url, head_snapshot FROM (SELECT repo_url, {head} AS head_snapshot FROM {refs} "
            f"WHERE ref IN ({q(branch)}, {q(rules.FALLBACK_BRANCH)}) GROUP BY repo_url) h WHERE head_snapshot IS NOT NULL")


def runs(mode_sql: str) -> str:
    """Runs of the fixture: known acme repositories, head by refs, base by the high-water mark."""
    return (f"SELECT r.url AS repo_url, r.id AS repository_id, r.last_reviewed_commit AS base_snapshot, "
            f"h.head_snapshot, {mode_sql} AS mode FROM run_repositories_v r "
            f"JOIN ({resolve_head('run_refs_v')}) h ON h.repo_url = r.url")


def diff(base: str, head: str) -> str:
    """Changed paths between two relations (repo_url, path, content), by set operations.

    Of the paths deleted with one content, as many as copies of it were added are left out, the first in
    path order: the k-th deleted path of a content is reported when k exceeds the number added.
    """
    keys = "repo_url, path"
    b = f"SELECT {keys}, sha256(content) AS hash FROM ({base}) b0"
    h = f"SELECT {keys}, sha256(content) AS hash FROM ({head}) h0"
    gone = f"SELECT {keys}, hash FROM ({b}) b1 ANTI JOIN ({h}) h1 USING ({keys})"
    new = f"SELECT {keys}, hash FROM ({h}) h2 ANTI JOIN ({b}) b2 USING ({keys})"
    edited = (f"SELECT h3.repo_url, h3.path FROM ({h}) h3 JOIN ({b}) b3 USING ({keys}) "
              f"WHERE h3.hash IS DISTINCT FROM b3.hash")
    left = (f"SELECT {keys} FROM (SELECT g.repo_url, g.path, rank() OVER (PARTITION BY g.repo_url, g.hash ORDER BY g.path) "
            f"AS k, CASE WHEN g.hash IS NULL THEN 0 ELSE (SELECT count(*) FROM ({new}) n WHERE n.repo_url = g.repo_url "
            f"AND n.hash = g.hash) END AS added FROM ({gone}) g) x WHERE k > added OR added = 0")
    return (f"SELECT {keys}, 'A' AS status FROM ({new}) n4 UNION ALL SELECT {keys}, 'M' FROM ({edited}) e4 "
            f"UNION ALL SELECT {keys}, 'D' FROM ({left}) l4")


def changed(runs_cte: str, files: str = "snapshots_v", full_too: bool = False) -> str:
    """Changes of every run with a base, other than runs in mode full."""
    wants = "r.base_snapshot IS NOT NULL AND r.base_snapshot <> r.head_snapshot" + ("" if full_too else " AND r.mode <> 'full'")
    side = lambda s: (f"SELECT DISTINCT f.repo_url, f.path, f.content FROM {files} f JOIN {runs_cte} r "  # noqa: E731
                      f"ON f.repo_url = r.repo_url AND f.snapshot_id = r.{s}_snapshot WHERE {wants}")
    return diff(side("base"), side("head"))


def head_files(runs_cte: str, files: str = "snapshots_v") -> str:
    return (f"SELECT f.repo_url, f.path, f.content FROM {files} f JOIN {runs_cte} r "
            f"ON f.repo_url = r.repo_url AND f.snapshot_id = r.head_snapshot")


def select_files(runs_cte: str, changed_cte: str, head_cte: str, max_files: int | None = None,
                 smart_cap: int | None = rules.SMART_CAP, recent_cap: int | None = rules.RECENT_FALLBACK_CAP) -> str:
    """The selection, one mode after the other: each is its own list of paths, cut to its cap."""
    src = ", ".join(q(e) for e in rules.SOURCE_EXTS)
    code = f"SELECT repo_url, path FROM {head_cte} h WHERE {code_file('path')}"
    source = f"SELECT repo_url, path FROM ({code}) c WHERE {ext('path')} IN ({src})"
    has = f"EXISTS (SELECT 1 FROM {changed_cte} x WHERE x.repo_url = r.repo_url)"

    def pick(where: str, rows: str, from_changes: str, *caps: int | None) -> str:
        cap = min((c for c in caps if c is not None), default=None)
        limit = "" if cap is None else f" QUALIFY row_number() OVER (PARTITION BY r.repo_url ORDER BY p.path) <= {cap}"
        return (f"(SELECT r.repo_url, p.path, {from_changes} AS from_changes, r.mode FROM {runs_cte} r "
                f"JOIN ({rows}) p ON p.repo_url = r.repo_url WHERE {where}{limit})")

    chg = f"SELECT repo_url, path FROM {changed_cte} c"
    lists = [
        pick("r.mode = 'full'", code, "false", max_files),
        pick(f"r.mode = 'smart' AND {has}", chg, "true", max_files, smart_cap),
        pick(f"r.mode = 'smart' AND NOT {has}", source, "false", max_files, smart_cap),
        pick(f"r.mode = 'recent' AND NOT {has}", code, "false", max_files, recent_cap),
        pick(f"r.mode NOT IN ('full', 'smart') AND {has}", chg, "true", max_files),
        pick(f"r.mode NOT IN ('full', 'smart', 'recent') AND NOT {has}", code, "false", max_files),
    ]
    return " UNION ALL ".join(lists)


def parse_urls(src: str, url: str = "url") -> str:
    """src columns plus owner, name, valid, parsed like urllib's path of the URL."""
    u = f"regexp_replace(regexp_replace({url}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    scheme_re = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    schemes = ", ".join(q(s) for s in rules.PARAM_SCHEMES)
    a = f"SELECT *, {u} AS _u FROM ({src}) p0"
    b = (f"SELECT *, regexp_replace(lower(regexp_extract(_u, '({scheme_re})', 1)), ':$', '') AS _scheme, "
         f"regexp_replace(regexp_replace(regexp_replace(_u, '{scheme_re}', ''), '^//[^/?#]*', ''), '(?s)[?#].*', '') "
         f"AS _path0 FROM ({a}) p1")
    c = (f"SELECT *, CASE WHEN _scheme IN ({schemes}) THEN regexp_replace(_path0, '(?s);[^/]*\\z', '') "
         f"ELSE _path0 END AS _path FROM ({b}) p2")
    d = (f"SELECT *, string_split(regexp_replace(regexp_replace(_path, '^/+', ''), '/+\\z', ''), '/') AS _parts "
         f"FROM ({c}) p3")
    return (f"SELECT * EXCLUDE (_u, _scheme, _path0, _path, _parts), "
            f"CASE WHEN len(_parts) >= 2 THEN _parts[1] END AS owner, "
            f"CASE WHEN len(_parts) >= 2 THEN regexp_replace(_parts[2], '\\.git\\z', '') END AS name, "
            f"len(_parts) >= 2 AS valid FROM ({d}) p4")


def runs_with_modes() -> str:
    return (f"SELECT r.url AS repo_url, r.id AS repository_id, r.last_reviewed_commit AS base_snapshot, "
            f"h.head_snapshot, lower(coalesce(nullif(m.mode, ''), {q(rules.DEFAULT_MODE)})) AS mode "
            f"FROM run_repositories_v r JOIN ({resolve_head('run_refs_v')}) h ON h.repo_url = r.url "
            f"JOIN runs_v m ON m.repo_url = r.url")


def headers(runs_cte: str, ts: str, start: int) -> str:
    branch = f"'{rules.REVIEW_BRANCH_PREFIX}' || substr(head_snapshot, 1, {rules.SHORT_SHA})"
    parsed = parse_urls(f"SELECT * FROM {runs_cte}", "repo_url")
    return (f"SELECT {start} + row_number() OVER (ORDER BY repo_url) AS id, "
            f"repo_url, repository_id, mode, head_snapshot AS commit_sha, {branch} AS branch, "
            f"'https://github.com/' || owner || '/' || name || '/pull/new/' || {branch} AS pr_url, "
            f"'Automated Review ' || substr(head_snapshot, 1, {rules.SHORT_SHA}) AS pr_title, "
            f"'Automated review for ' || head_snapshot AS commit_message, {ts} AS created_at FROM ({parsed}) hp")


def renames(base: str, head: str, similar: float = 0.5, similar_name: float = 0.75, limit: int = 1000) -> str:
    """(repo_url, old_path, path, score) of all renames between two views, all pairs compared, pairs taken one by one."""
    text = "replace(content, chr(13) || chr(10), chr(10))"
    chunk = q("[^\n]{0,63}\n|[^\n]{1,64}")

    def name(path: str) -> str:
        return f"regexp_extract({path}, '[^/]*\\z')"

    def bag(view: str) -> str:
        return (f"SELECT repo_url, path, size, piece, sum(strlen(piece))::BIGINT AS bytes FROM (SELECT repo_url, path, "
                f"strlen({text}) AS size, unnest(regexp_extract_all({text}, {chunk})) AS piece FROM {view}) p GROUP BY ALL")

    def ranked(view: str) -> str:
        return f"SELECT repo_url, path, content, row_number() OVER (PARTITION BY repo_url, content ORDER BY path) AS k FROM {view}"

    return f"""
WITH gone AS (SELECT b.* FROM {base} b ANTI JOIN {head} h ON b.repo_url = h.repo_url AND b.path = h.path),
come AS (SELECT h.* FROM {head} h ANTI JOIN {base} b ON b.repo_url = h.repo_url AND b.path = h.path),
exact AS (SELECT g.repo_url, g.path AS old_path, c.path FROM ({ranked("gone")}) g JOIN ({ranked("come")}) c
  ON g.repo_url = c.repo_url AND g.content = c.content AND g.k = c.k),
gone2 AS (SELECT g.* FROM gone g ANTI JOIN exact e ON e.repo_url = g.repo_url AND e.old_path = g.path WHERE content <> ''),
come2 AS (SELECT c.* FROM come c ANTI JOIN exact e ON e.repo_url = c.repo_url AND e.path = c.path WHERE content <> ''),
scored AS (SELECT g.repo_url, g.path AS old_path, c.path, sum(least(g.bytes, c.bytes))::DOUBLE / greatest(g.size, c.size) AS score
  FROM ({bag("gone2")}) g JOIN ({bag("come2")}) c ON g.repo_url = c.repo_url AND g.piece = c.piece
  GROUP BY g.repo_url, g.path, c.path, g.size, c.size),
single_old AS (SELECT repo_url, {name("path")} AS name, min(path) AS path FROM gone2 GROUP BY ALL HAVING count(*) = 1),
single_new AS (SELECT repo_url, {name("path")} AS name, min(path) AS path FROM come2 GROUP BY ALL HAVING count(*) = 1),
named AS (SELECT s.* FROM scored s JOIN single_old o ON o.repo_url = s.repo_url AND o.path = s.old_path
  JOIN single_new n ON n.repo_url = s.repo_url AND n.path = s.path WHERE o.name = n.name AND score >= {similar_name}),
gone3 AS (SELECT g.* FROM gone2 g ANTI JOIN named n ON n.repo_url = g.repo_url AND n.old_path = g.path),
come3 AS (SELECT c.* FROM come2 c ANTI JOIN named n ON n.repo_url = c.repo_url AND n.path = c.path),
searched AS (SELECT repo_url FROM (SELECT repo_url, count(*) AS n FROM gone3 GROUP BY ALL) JOIN
  (SELECT repo_url, count(*) AS m FROM come3 GROUP BY ALL) USING (repo_url) WHERE n * m <= {limit * limit}),
open AS (SELECT s.* FROM scored s SEMI JOIN gone3 g ON g.repo_url = s.repo_url AND g.path = s.old_path
  SEMI JOIN come3 c ON c.repo_url = s.repo_url AND c.path = s.path SEMI JOIN searched r ON r.repo_url = s.repo_url WHERE score >= {similar}),
inorder AS (SELECT repo_url, list({{'o': old_path, 'p': path, 's': score}}
  ORDER BY score DESC, {name("old_path")} <> {name("path")}, path, old_path) AS pairs FROM open GROUP BY repo_url),
taken AS (SELECT repo_url, unnest(list_reduce(pairs, lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda y: y.o = x[1].o OR y.p = x[1].p)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS t
  FROM (SELECT repo_url, [[x] for x in pairs] AS pairs FROM inorder) w)
SELECT repo_url, old_path, path, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT * FROM named
UNION ALL SELECT repo_url, t.o, t.p, t.s FROM taken"""
