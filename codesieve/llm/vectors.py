"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors are first made one, with their count.  Centroids are fitted on a bounded sample; every
vector is put in the cell of its nearest centroid.  Two vectors x in cell i and y in cell j whose cosine
is at least t lie on different sides of the plane between the (unit) centroids, so their distances to it
add up to at most |x - y| <= sqrt(2 - 2t).  A vector therefore also visits each lower-numbered cell whose
plane is that near, and is compared there only with residents near enough on the other side.  No link
is lost, whatever the centroids; well separated cells get few visitors, vectors spread evenly in all
directions get many.

A cell of any size is cut into blocks of ``block_rows``; a task compares one block with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import stored
from codesieve.llm.components import components, forest

THRESHOLD = 0.95
CELL_ROWS = 4096
MAX_CELLS = 4096
SAMPLE_ROWS = 16_384
BLOCK_ROWS = 2048
_SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    """Equally long vectors as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit rows: at most k distinct unit centroids."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)
    return np.unique(c, axis=0)


def _margins(x: np.ndarray, c: np.ndarray, home: int, other: int) -> np.ndarray:
    """Distances of unit rows of cell ``home`` to the plane between it and cell ``other``."""
    gap = c[home] - c[other]
    return x @ (gap / np.linalg.norm(gap))


def usable(vector: Column) -> Column:
    """A vector that can link: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def assign_cells(unique: DataFrame, centroids: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """unique (vid, copies, vector) plus home cell and the lower cells that it visits.

    Vectors of another length than the centroids share one cell per length, numbered -length.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    k, d = centroids.shape

    def run(batches):
        # distances of the unit centroids from their cosines: k x k numbers
        apart = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0))
        for b in batches:
            lengths = b.column("vector").value_lengths().to_numpy()
            home = -lengths.astype(np.int64)
            visits: list = [[]] * len(home)
            fit = np.flatnonzero(lengths == d)
            if len(fit):
                dots = _matrix(b.column("vector").take(pa.array(fit))) @ centroids.T
                near = np.argmax(dots, axis=1)
                home[fit] = near
                gap = dots[np.arange(len(fit)), near][:, None] - dots
                open_ = (gap <= reach * apart[near]) & (np.arange(k)[None] < near[:, None])
                for at, row in zip(fit, open_):
                    visits[at] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(home), pa.array(visits, pa.list_(pa.int64()))], [*b.schema.names, "home", "visits"])

    return unique.mapInArrow(run, "vid long, copies long, vector array<double>, home long, visits array<long>")


def _links_in(x, y, ids_x, ids_y, n_x, n_y, t, near_x=None, near_y=None, reach=0.0):
    """(edges a, b, link counts of x, of y) of all pairs across two blocks; near_*: distances to the plane between them."""
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    if near_x is not None:
        ox, oy = np.argsort(near_x, kind="stable"), np.argsort(near_y, kind="stable")
        near_x, near_y = near_x[ox], near_y[oy]
    else:
        ox, oy = np.arange(len(x)), np.arange(len(y))
    a, b = [], []
    for lo in range(0, len(x), 256):
        some = ox[lo:lo + 256]
        others = oy if near_x is None else oy[:np.searchsorted(near_y, reach - near_x[lo], side="right")]
        if not len(others):
            break
        i, j = np.nonzero(x[some] @ y[others].T >= t)
        i, j = some[i], others[j]
        if x is y:
            i, j = i[i < j], j[i < j]
        count_x += np.bincount(i, n_y[j], len(x)).astype(np.int64)
        count_y += np.bincount(j, n_x[i], len(y)).astype(np.int64)
        p, q = forest(ids_x[i], ids_y[j])
        a.append(p)
        b.append(q)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count_x, count_y
    return *forest(np.concatenate(a), np.concatenate(b)), count_x, count_y


def compare_blocks(cells: DataFrame, centroids: np.ndarray, threshold: float = THRESHOLD,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """cells (vid, copies, vector, home, visits) -> rows (a, b, n): edges (a, b, null) that join all linked
    vectors, as a forest for each pair of blocks, and link counts (a, null, n) to be summed by a."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    residents = cells.select("vid", "copies", "vector", "home", F.col("home").alias("cell"))
    visitors = cells.select("vid", "copies", "vector", "home", F.explode("visits").alias("cell"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block_rows)).cast("long")
    sizes = (cells.groupBy(F.col("home").alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
             .join(cells.select(F.explode("visits").alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_m")),
                   F.col("_cell") == F.col("_v"), "left")
             .select("_cell", blocks("_n").alias("_p"), F.coalesce(blocks("_m"), F.lit(0)).cast("long").alias("_q")))
    sizes = stored(sizes, "cell-sizes")
    own = residents.join(sizes, F.col("cell") == F.col("_cell")).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("_p")))
    to = F.sequence(F.lit(0).cast("long"), F.col("_p") - 1)
    span = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(
        F.array().cast("array<long>"))
    # residents meet each other (visit false) and every block of visitors (visit true)
    meet = F.concat(
        F.transform(to, lambda o: F.struct(F.lit(False).alias("visit"), F.least("own", o).alias("p"), F.greatest("own", o).alias("q"))),
        F.transform(span("_q"), lambda o: F.struct(F.lit(True).alias("visit"), F.col("own").alias("p"), o.alias("q"))))
    rows = own.select("cell", "home", "vid", "copies", "vector", F.lit(False).alias("guest"), "own", F.explode(meet).alias("m"))
    come = visitors.join(sizes, F.col("cell") == F.col("_cell")).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("_q")))
    rows = rows.union(come.select(
        "cell", "home", "vid", "copies", "vector", F.lit(True).alias("guest"), "own",
        F.explode(F.transform(to, lambda o: F.struct(F.lit(True).alias("visit"), o.alias("p"), F.col("own").alias("q")))).alias("m")))
    rows = rows.select("cell", "m.visit", "m.p", "m.q", "home", "vid", "copies", "vector", "guest", "own")

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table["vector"])
        vid, n = table["vid"].to_numpy(), table["copies"].to_numpy()
        guest, own_block, home = (table[c].to_numpy() for c in ("guest", "own", "home"))
        visit, p, q, cell = (table[c][0].as_py() for c in ("visit", "p", "q", "cell"))
        count = np.zeros(len(vid), np.int64)
        a, b = [], []

        def meet_blocks(i, j, near_x=None, near_y=None):
            ids = (x[i], vid[i], n[i])
            other = ids if j is None else (x[j], vid[j], n[j])
            ea, eb, cx, cy = _links_in(ids[0], other[0], ids[1], other[1], ids[2], other[2], threshold, near_x, near_y, reach)
            count[i] += cx
            count[i if j is None else j] += cy
            a.append(ea)
            b.append(eb)

        if not visit and p == q:
            meet_blocks(np.arange(len(vid)), None)
        elif not visit:
            meet_blocks(np.flatnonzero(own_block == p), np.flatnonzero(own_block == q))
        else:
            here = np.flatnonzero(~guest)
            for h in np.unique(home[guest]):
                come = np.flatnonzero(guest & (home == h))
                meet_blocks(come, here, _margins(x[come], centroids, h, cell), _margins(x[here], centroids, cell, h))
        ea, eb = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        hit = np.flatnonzero(count)
        return pa.table({"a": pa.array(np.concatenate([ea, vid[hit]]), pa.int64()),
                         "b": pa.array([*eb.tolist(), *[None] * len(hit)], pa.int64()),
                         "n": pa.array([*[None] * len(ea), *count[hit].tolist()], pa.int64())})

    return rows.groupBy("cell", "visit", "p", "q").applyInArrow(run, "a long, b long, n long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                     cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, sample_rows: int = SAMPLE_ROWS,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, n_links, component_id (smallest id reachable), kept (id = component_id).

    All vectors count whatever their labels; other columns are not read.  Vectors that are null, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths.  Repeated
    rows are vectors of their own.  Rows with a null id link and count; a group of null ids alone has a
    null component and all its rows are kept.  An empty table gives no rows.

    The centroids are fitted on at most ``sample_rows`` distinct vectors of the commonest length, chosen
    by hash; there are at most ``max_cells`` of them, so they are small enough to send to every task.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector), lambda c: c.cast("double") + F.lit(0.0)).alias("vector"))
    good = v.filter(usable(F.col("vector")))
    # equal vectors are one row with their count; the written table fixes vid
    unique = stored(good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
                    .select(F.monotonically_increasing_id().alias("vid"), "copies", "low", "vector"), "vectors")
    common = unique.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return v.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                        F.lit(True).alias("kept"))
    k = min(max_cells, -(-common["n"] // cell_rows))
    sample = (unique.filter(F.size("vector") == common["d"]).select("vector")
              .orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).toArrow())
    centroids = fit_centroids(_matrix(sample["vector"]), k)
    cells = stored(assign_cells(unique.select("vid", "copies", "vector"), centroids, threshold), "cells")
    found = stored(compare_blocks(cells, centroids, threshold, block_rows), "links")
    group = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("n is not null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_links"))
    full = (unique.select("vid", "copies", "low", "vector").join(counts, F.col("vid") == F.col("_a"), "left")
            .join(group, F.col("vid") == F.col("node"), "left")
            .select("vector", "low", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "vid").alias("label")))
    lows = full.groupBy("label").agg(F.min("low").alias("component_id"))
    known = full.join(lows, "label").select(F.col("vector").alias("_v"), "n_links", "component_id")
    return (v.join(known, F.when(usable(F.col("vector")), F.col("vector")) == F.col("_v"), "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("_v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
