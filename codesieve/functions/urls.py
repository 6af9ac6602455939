"""Repository URL parsing (T15, T16) as column expressions.

The path is taken the way ``urllib.parse.urlparse`` takes it: leading C0
controls and spaces dropped, tabs and newlines removed, an optional scheme
(a letter, then letters, digits, ``+ - .``, up to the first ``:``), an
optional ``//authority``, then query and fragment cut; for schemes that
carry parameters, ``;params`` after the last ``/`` is dropped.  The owner
and name are the first two parts of the path stripped of ``/``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve import rules
from codesieve.functions.text import _c, ColumnOrName

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def url_path(url: ColumnOrName) -> Column:
    u = F.regexp_replace(F.regexp_replace(_c(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(u, "(" + SCHEME + ")", 1))
    rest = F.regexp_replace(u, SCHEME, "")
    rest = F.regexp_replace(rest, r"^//[^/?#]*", "")
    path = F.regexp_replace(rest, r"(?s)[?#].*", "")
    scheme_name = F.regexp_replace(scheme, ":$", "")
    with_params = scheme_name.isin(rules.PARAM_SCHEMES)
    return F.when(with_params, F.regexp_replace(path, r"(?s);[^/]*\z", "")).otherwise(path)


def parse_repo_url(url: ColumnOrName) -> Column:
    """struct(owner, name); both null when the path has fewer than two parts."""
    parts = F.split(F.regexp_replace(url_path(url), r"^/+|/+\z", ""), "/", -1)
    ok = F.size(parts) >= F.lit(2)
    owner = F.when(ok, F.get(parts, 0))
    name = F.when(ok, F.regexp_replace(F.get(parts, 1), r"\.git\z", ""))
    return F.struct(owner.alias("owner"), name.alias("name"))


def local_key(owner: ColumnOrName, name: ColumnOrName) -> Column:
    """``owner__name`` working-copy key."""
    return F.concat_ws("__", _c(owner), _c(name))
