"""Print the final adaptive plan of a registered query.

Usage: python tools/explain.py NAME [sf_dir] [mode]   (mode: formatted | simple | cost)
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")
from codesieve.plans import catalog  # noqa: E402
from codesieve.session import build_session  # noqa: E402


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    mode = sys.argv[3] if len(sys.argv) > 3 else "formatted"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    df = catalog.SPARK[name](spark, sf_dir)
    df.collect()  # run it, so the adaptive plan shown is the final one
    df.explain(mode)
    spark.stop()


if __name__ == "__main__":
    main()
