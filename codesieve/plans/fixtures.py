"""Derived views over the driver tables, written once for Spark and DuckDB.

The driver tables hold prose, orders and events rather than source trees,
so the registered queries run on views derived from them: ``files_v``
turns ``documents`` into code-like files of many repositories, ``base_v``
is an earlier snapshot of them, ``reviews_v`` comes from ``orders`` and so
on.  Every view reads a whole driver table, so query work grows with it.

SQL text uses ``$name`` tokens for tables and a few dialect tokens; the
same text is rendered for Spark (temp views with session-unique names) and
for DuckDB (a ``WITH`` list over the pre-registered driver views).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DIALECT = {
    "spark": {"$NTZ": "TIMESTAMP_NTZ", "$G": "", "$EXPLODE": "explode", "$LIST": "array"},
    "duckdb": {"$NTZ": "TIMESTAMP", "$G": ", 'g'", "$EXPLODE": "unnest", "$LIST": "list_value"},
}

# Each view: (SQL text, views it reads).  Table tokens are $name.
VIEWS: dict[str, str] = {}

# every document is a file holding its whole text behind a code snippet; beside some of them stand an
# empty file and a long plain one, so both occur in every repository
VIEWS["files_v"] = """
SELECT concat('https://github.com/acme/', source) AS repo_url, 'head' AS snapshot_id, doc_id,
  concat(CASE doc_id % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'lib/core' WHEN 2 THEN '.github' WHEN 3 THEN '.git/hooks'
    WHEN 4 THEN 'docs' WHEN 5 THEN 'algo/two_pointers' ELSE 'web' END,
    '/f', lpad(cast(doc_id AS string), cast(greatest(7, length(cast(doc_id AS string))) AS int), '0'), kind,
    CASE doc_id % 15 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.tsx' WHEN 4 THEN '.jsx'
      WHEN 5 THEN '.java' WHEN 6 THEN '.cpp' WHEN 7 THEN '.c' WHEN 8 THEN '.go' WHEN 9 THEN '.rs' WHEN 10 THEN '.md'
      WHEN 11 THEN '.txt' WHEN 12 THEN '.PY' WHEN 13 THEN '.bin' ELSE '' END) AS path,
  CASE WHEN kind = '_empty' THEN ''
    WHEN kind = '_long' THEN repeat(concat('x = 1', chr(10)), 300)
    WHEN doc_id % 11 = 0 THEN replace(concat(snippet, chr(10), text), chr(10), concat(chr(13), chr(10)))
    ELSE concat(snippet, chr(10), text) END AS content
FROM (SELECT doc_id, source, text, $EXPLODE(CASE WHEN doc_id % 425 = 0 THEN $LIST('', '_empty', '_long')
    WHEN doc_id % 25 = 0 THEN $LIST('', '_empty') WHEN doc_id % 17 = 0 THEN $LIST('', '_long') ELSE $LIST('') END) AS kind,
  CASE doc_id % 10
    WHEN 0 THEN ''
    WHEN 1 THEN concat('import os', chr(10), 'def load(path):', chr(10), '    return load(path)')
    WHEN 2 THEN 'const go = (a) => { for (;;) { for (;;) { } } }'
    WHEN 3 THEN concat('import z', chr(10), 'function add(p) { return p }')
    WHEN 4 THEN concat('def d1(): pass', chr(10), 'def d2(): pass', chr(10), 'def d1(): pass', chr(10), 'def d3(): d1()', chr(10), 'def d4(): pass')
    WHEN 5 THEN concat('low = 0', chr(10), 'high = 9')
    WHEN 6 THEN concat('package util', chr(10), 'import fmt')
    WHEN 7 THEN concat('for x in y:', chr(10), '    for z in x:')
    WHEN 8 THEN concat('visited.remove(n)', chr(10), 'path.pop()') ELSE 'dp[0] = 1' END AS snippet
  FROM $documents) d
"""

VIEWS["base_v"] = """
SELECT repo_url, 'base' AS snapshot_id, path,
  CASE WHEN doc_id % 8 = 0 AND repo_url <> 'https://github.com/acme/src1' THEN concat(content, ' old') ELSE content END AS content
FROM $files_v WHERE repo_url <> 'https://github.com/acme/src2' AND (doc_id % 9 <> 0 OR repo_url = 'https://github.com/acme/src1')
UNION ALL
SELECT repo_url, 'base' AS snapshot_id, concat('old/', path) AS path, content
FROM $files_v WHERE doc_id % 13 = 0 AND repo_url NOT IN ('https://github.com/acme/src1', 'https://github.com/acme/src2')
"""

VIEWS["snapshots_v"] = """
SELECT repo_url, snapshot_id, path, content FROM $files_v
UNION ALL
SELECT repo_url, snapshot_id, path, content FROM $base_v
"""

# a repository reordered: files stay, move to another folder and are edited, get another name and lose their end,
# are copied under a common name, or go while others come; the folders of a document's number change on the way
VIEWS["moved_base_v"] = """
SELECT repo_url, path, content FROM (SELECT repo_url, concat('old/', path) AS path, doc_id,
  CASE WHEN doc_id % 6 = 4 THEN concat('x = 1', chr(10), content) ELSE content END AS content FROM $files_v) f
WHERE doc_id % 6 <> 5
"""

VIEWS["moved_head_v"] = """
SELECT repo_url, CASE doc_id % 6 WHEN 0 THEN concat('old/', path) WHEN 1 THEN concat('new/', path)
    WHEN 2 THEN concat('new/g', cast(doc_id * 7 AS string), '_', cast(length(path) AS string), '.txt') WHEN 3 THEN concat('new/d', cast(doc_id AS string), '_', cast(length(path) AS string), '/index.py')
    ELSE concat('new/', path) END AS path,
  CASE doc_id % 6 WHEN 1 THEN concat('# moved', chr(10), content)
    WHEN 2 THEN substr(content, 1, cast(length(content) - length(content) * (doc_id % 5) / 8 AS int))
    WHEN 3 THEN concat(content, chr(10), 'end = ', cast(doc_id AS string)) ELSE content END AS content
FROM $files_v WHERE doc_id % 6 <> 4 OR doc_id % 4 = 0
"""

VIEWS["refs_v"] = """
SELECT repo_url, 'origin/main' AS ref, concat('m', md5(repo_url)) AS snapshot_id
FROM $files_v WHERE doc_id % 2 = 0 GROUP BY repo_url
UNION ALL
SELECT repo_url, 'origin/master' AS ref, concat('s', md5(repo_url)) AS snapshot_id
FROM $files_v GROUP BY repo_url
"""

# head refs of the review run: repositories src0..src9 have origin/main, src10.. only origin/master
VIEWS["run_refs_v"] = """
SELECT repo_url, CASE WHEN length(repo_url) % 2 = 0 THEN 'origin/main' ELSE 'origin/master' END AS ref,
  'head' AS snapshot_id
FROM $files_v GROUP BY repo_url
UNION ALL
SELECT repo_url, 'origin/dev' AS ref, 'base' AS snapshot_id FROM $files_v GROUP BY repo_url
"""

VIEWS["repositories_v"] = """
SELECT c_custkey AS id, lower(c_mktsegment) AS owner, lower(replace(c_name, '#', '-')) AS name,
  concat('https://github.com/', lower(c_mktsegment), '/', lower(replace(c_name, '#', '-'))) AS url,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE md5(cast(c_custkey AS string)) END AS last_reviewed_commit,
  CAST('2024-01-01 00:00:00' AS $NTZ) AS created_at, CAST('2024-01-01 00:00:00' AS $NTZ) AS updated_at
FROM $customer
"""

# repositories of the review run: every acme repository is known, src2 was never reviewed
VIEWS["run_repositories_v"] = """
SELECT id, owner, name, url, last_reviewed_commit, created_at, updated_at FROM $repositories_v
UNION ALL
SELECT 0 - 1 - cast(substr(repo_url, 28) AS bigint) AS id, 'acme' AS owner, substr(repo_url, 25) AS name,
  repo_url AS url, CASE WHEN repo_url = 'https://github.com/acme/src2' THEN NULL ELSE 'base' END AS last_reviewed_commit,
  CAST('2024-01-01 00:00:00' AS $NTZ) AS created_at, CAST('2024-01-01 00:00:00' AS $NTZ) AS updated_at
FROM $files_v GROUP BY repo_url
"""

VIEWS["reviews_v"] = """
SELECT o_orderkey AS id, o_custkey AS repository_id, md5(cast(o_orderkey AS string)) AS commit_sha,
  concat('review/auto-', substr(md5(cast(o_orderkey AS string)), 1, 7)) AS branch,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat('https://github.com/pr/', cast(o_orderkey AS string)) END AS pr_url,
  o_orderdate AS created_at
FROM $orders
"""

VIEWS["feedback_v"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS review_id,
  concat('src/f', cast(l_partkey AS string), '.py') AS file_path,
  CASE WHEN l_returnflag = 'N' THEN 'development' ELSE 'DSA' END AS classification,
  concat('note ', cast(l_suppkey AS string)) AS feedback, l_shipdate AS created_at
FROM $lineitem
"""

VIEWS["urls_v"] = """
SELECT page_id AS id, url FROM $pages
UNION ALL
SELECT * FROM (VALUES (-1, 'https://github.com/o/r.git'), (-2, 'git@github.com:o/r.git'), (-3, 'https://github.com/o'),
  (-4, 'https://tok@github.com/o/r/tree/main?x=1#f'), (-5, 'https://github.com//o/r/'), (-6, 'https://github.com/o/r;p'))
  AS t(id, url)
"""

VIEWS["requests_v"] = """
SELECT event_id, user_id,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat('https://github.com/acme/src', cast(user_id % 20 AS string)) END AS repo,
  CASE user_id % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'Recent' WHEN 2 THEN 'smart' WHEN 3 THEN '' ELSE 'other' END AS mode,
  cast(floor(value) AS int) AS page_limit
FROM $events
"""

# one run per requested repository; its mode as requested
VIEWS["runs_v"] = """
SELECT repo AS repo_url, min(mode) AS mode FROM $requests_v WHERE repo IS NOT NULL GROUP BY repo
"""

# replies with one object, none, a broken one, repeated keys, a null, two objects and trailing text
VIEWS["replies_v"] = """
SELECT conv_id, turn,
  CASE (conv_id + turn) % 8
    WHEN 0 THEN concat('Sure: {"classification": " dsa ", "feedback": "', words, '"} done')
    WHEN 1 THEN concat('{"feedback": " ', words, ' ok "}')
    WHEN 2 THEN concat('{broken ', text)
    WHEN 4 THEN concat('{"classification": "DSA", "feedback": "first", "classification": "other", "feedback": "', words, ' last"}')
    WHEN 5 THEN concat('{"feedback": "', words, '"} or {"feedback": "two"}')
    WHEN 6 THEN concat('{"classification": "x", "feedback": "', words, '", "classification": "dsa", "feedback": null}')
    ELSE text END AS reply
FROM (SELECT conv_id, turn, text, regexp_replace(text, '[^A-Za-z ]', ''$G) AS words FROM $conversations) c
"""

# model replies keyed by file: every turn of the conversation numbered like the document
VIEWS["file_replies_v"] = """
SELECT f.repo_url, f.path, r.turn, r.reply FROM $files_v f JOIN $replies_v r ON r.conv_id = f.doc_id
"""

# numbered requests of all events, some for addresses that are no repository and some without a head
VIEWS["asked_v"] = """
SELECT event_id AS request_id, CASE WHEN event_id % 50 = 0 THEN 'https://github.com/nobody'
  WHEN event_id % 51 = 0 THEN concat('https://github.com/acme/none', cast(user_id AS string)) ELSE repo END AS repo_url, mode
FROM $requests_v
"""

_TOKEN = re.compile(r"\$([a-z_]+)")


def dependencies(name: str) -> list[str]:
    return [t for t in _TOKEN.findall(VIEWS[name]) if t in VIEWS]


def ordered_views(names: list[str]) -> list[str]:
    """Views needed by ``names`` in dependency order."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in dependencies(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def render(sql: str, dialect: str, names: dict[str, str] | None = None) -> str:
    for tok, val in DIALECT[dialect].items():
        sql = sql.replace(tok, val)
    names = names or {}
    return _TOKEN.sub(lambda m: names.get(m.group(1), m.group(1)), sql)


def duckdb_with(body: str, views: list[str]) -> str:
    """DuckDB SQL: ``WITH`` every needed view, then ``body`` (which uses plain view names)."""
    need = ordered_views(views)
    if not need:
        return body
    ctes = ",\n".join(f"{v} AS ({render(VIEWS[v], 'duckdb').strip()})" for v in need)
    return f"WITH {ctes}\n{body}"


class Fixtures:
    """Spark side of the views for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tag = hashlib.md5(self.sf_dir.encode()).hexdigest()[:8]
        self._names: dict[str, str] = {}

    def _name(self, n: str) -> str:
        return f"cs_{self._tag}_{n}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _register(self, n: str) -> str:
        if n in self._names:
            return self._names[n]
        if n in VIEWS:
            for d in dependencies(n):
                self._register(d)
            for t in _TOKEN.findall(VIEWS[n]):
                if t not in VIEWS:
                    self._register(t)
            df = self.spark.sql(render(VIEWS[n], "spark", self._names))
        else:
            df = self.table(n)
        df.createOrReplaceTempView(self._name(n))
        self._names[n] = self._name(n)
        return self._names[n]

    def view(self, name: str) -> DataFrame:
        return self.spark.table(self._register(name))

    def files(self) -> DataFrame:
        """``files_v``, dealt evenly over tasks by its keys.

        The driver's small tables are one row group, hence one task, each; a stored files table would
        arrive in many splits.  This lays the derived data out, it is no part of any operator.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.view("files_v").repartition(n, "repo_url", "path")
