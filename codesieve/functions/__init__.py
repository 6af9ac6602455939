"""Column functions for file text, paths, urls and timestamps."""

from codesieve.functions.text import (  # noqa: F401
    basename,
    comment_prefix,
    complexity_hints,
    detect_topic,
    dirname,
    file_extension,
    function_label,
    function_names,
    has_nested_loops,
    has_recursion,
    is_dsa,
    iso_timestamp,
    line_count,
    loop_count,
    normalize_newlines,
    review_text,
    separator_prefix,
    strip_ws,
    variant_seed,
)
from codesieve.functions.urls import local_key, parse_repo_url  # noqa: F401
