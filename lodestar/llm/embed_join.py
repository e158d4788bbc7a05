"""Embedding near-dedup as an exact metric range join.

Unit vectors of one label with cosine >= c lie within r = sqrt(2 - 2c) of each other. Pivots part the vectors of a label into
cells by the nearest pivot; their number grows with the vectors, so cells don't. By the triangle inequality a partner of x
whose home is another cell lies no further than r from the border of x's cell, so every vector is also sent to each cell
whose border is within r; then the cells are joined independently, each home vector with all vectors of its cell. Large
cells are joined in tiles of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Vectors that a cell should have; bytes of the pivots that all tasks get at most; home vectors and others of a tile.
CELL, PIVOT_BYTES, TILE, OTHERS = 1500, 32 << 20, 2048, 8192
#: Numbers that a task holds of a product at once.
AT_ONCE = 1 << 21
#: Slack of the border test against rounding.
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy() if isinstance(column, pd.Series) else column).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding, label):
    """Whether a vector can link at all: a label, and finite components that are not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(label.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0), F.lit(False))


#: Vectors become pivots whose hash modulo this is below a share of it.
HASHES = 1 << 62


def pivot_share(vectors: int, width: int) -> int:
    """Below which of HASHES a vector's hash makes it a pivot: one in CELL, as long as all fit in PIVOT_BYTES."""
    return int(min(vectors / CELL, PIVOT_BYTES / (8 * max(1, width))) * HASHES) // max(1, vectors)


def _cells(pivots: dict[tuple, np.ndarray], radius: float):
    """Send each vector to its home cell, and as a guest to the cells whose border is near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_label = defaultdict(list)
            for i, key in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                by_label[key].append(i)
            rows, cells, homes = [], [], []
            for key, at in by_label.items():
                p, at = pivots.get(key), np.array(at)
                if p is None:
                    rows.append(at)
                    cells.append(np.zeros(len(at), np.int64))
                    homes.append(np.ones(len(at), bool))
                    continue
                x = _unit(np.array(b.column(1).take(pa.array(at)).to_pylist(), np.float64))
                step = max(1, AT_ONCE // len(p))
                for lo in range(0, len(x), step):
                    near = x[lo : lo + step] @ p.T
                    home = near.argmax(axis=1)
                    of, place = np.unique(home, return_inverse=True)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (p[of] @ p.T)))[place]
                    # a vector's distance to the plane between two pivots is the difference of its products over theirs
                    sent = near[np.arange(len(near)), home][:, None] - near <= radius * apart + SLACK
                    i, c = np.nonzero(sent)
                    rows.append(at[lo + i])
                    cells.append(c)
                    homes.append(home[i] == c)
            if rows:
                take = b.take(pa.array(np.concatenate(rows)))
                yield pa.record_batch([*take.columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(homes))], [*take.schema.names, "cell", "home"])

    return run


def _tile(cosine: float):
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each home vector of the tile its links to the tile's other side; and a forest over all that link."""
        own, other = pdf[pdf["as_home"]], pdf[pdf["as_other"]]
        if own.empty or other.empty:
            return pd.DataFrame({"rep": [], "n": [], "to": []}).astype("int64")
        a, b = own["rep"].to_numpy(), other["rep"].to_numpy()
        u, v, copies = _unit(_matrix(own["embedding"])), _unit(_matrix(other["embedding"])), other["copies"].to_numpy()
        step, most = max(1, AT_ONCE // len(b)), np.iinfo(np.int64).max
        links, n = np.empty((len(a), len(b)), bool), np.zeros(len(a), np.int64)
        parts = [slice(lo, lo + step) for lo in range(0, len(a), step)]
        for k in parts:
            links[k] = (u[k] @ v.T >= cosine) & (a[k, None] != b[None, :])
            n[k] = links[k] @ copies
        # the least vector that links reach within the tile
        x, y = a.copy(), b.copy()
        while True:
            x2, y2 = x.copy(), y.copy()
            for k in parts:
                x2[k] = np.minimum(x[k], np.where(links[k], y[None, :], most).min(axis=1))
                y2 = np.minimum(y2, np.where(links[k], x2[k, None], most).min(axis=0))
            if (x2 == x).all() and (y2 == y).all():
                break
            x, y = x2, y2
        rows, columns = links.any(axis=1), links.any(axis=0)
        return pd.DataFrame({"rep": np.concatenate([a[rows], b[columns]]), "n": np.concatenate([n[rows], np.zeros(columns.sum(), np.int64)]), "to": np.concatenate([x[rows], y[columns]])}).astype("int64")

    return join


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors link if they have the same label and a cosine of at least `cosine` in double precision. Vectors that are null,
    empty, zero or of another length, or hold null or non-finite components, and those without a label or id, link with
    nothing. Equal vectors count as one with copies and are not compared. Rows that repeat an id are vectors of their own.
    kept tells whether a vector is the least of its component. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding"), F.col("label"))
    rows = rows.withColumn("one", F.when(good, F.xxhash64("embedding"))).withColumn("two", F.when(good, F.xxhash64(F.reverse("embedding"))))
    rows = shared.stash(rows.withColumn("width", F.size("embedding")), "vectors")
    key = ["label", "width", "one", "two"]
    least = rows.where("one is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    least = shared.stash(least, "least")
    reps = rows.join(least, key).where("vec_id = rep").dropDuplicates([*key, "rep"]).select("rep", "embedding", "label", "width", "copies")
    reps = shared.stash(reps, "reps")
    total, widest = reps.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(1))).first()
    chosen = reps.where(F.pmod(F.xxhash64("rep"), F.lit(HASHES)) < pivot_share(total, widest)).select("label", "width", "embedding").collect()  # PIVOT_BYTES or so at most
    pivots = defaultdict(list)
    for r in chosen:
        pivots[r["label"], r["width"]].append(r["embedding"])
    pivots = {k: _unit(np.array(v, np.float64)) for k, v in pivots.items() if len(v) > 1}

    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    schema = reps.select("rep", "embedding", "label", "width", "copies", F.lit(0).alias("cell"), F.lit(True).alias("home")).schema
    sent = shared.stash(reps.mapInArrow(_cells(pivots, radius), schema), "sent")
    sizes = sent.groupBy("label", "width", "cell").agg(F.ceil(F.count_if("home") / TILE).cast("int").alias("hs"), F.ceil(F.count("*") / OTHERS).cast("int").alias("os"))
    sizes = shared.stash(sizes.where("hs > 0"), "sizes")  # no home vector, nothing to meet
    placed = sent.join(shared.small(sizes), ["label", "width", "cell"]).withColumns({"h": F.pmod(F.xxhash64("rep"), F.col("hs")).cast("int"), "o": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("os")).cast("int")})
    # a home vector meets every block of its cell; every vector is met by every block of home vectors
    met = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda i: F.struct(i.alias("h"), F.col("o").alias("o"), (F.col("home") & (i == F.col("h"))).alias("as_home"), F.lit(True).alias("as_other")))
    meets = F.transform(F.filter(F.sequence(F.lit(0), F.col("os") - 1), lambda i: F.col("home") & (i != F.col("o"))), lambda i: F.struct(F.col("h").alias("h"), i.alias("o"), F.lit(True).alias("as_home"), F.lit(False).alias("as_other")))
    tiles = placed.withColumn("at", F.explode(F.concat(met, meets))).select("label", "width", "cell", "at.h", "at.o", "at.as_home", "at.as_other", "rep", "copies", "embedding")
    found = shared.stash(tiles.groupBy("label", "width", "cell", "h", "o").applyInPandas(_tile(cosine), "rep long, n long, to long"), "found")

    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = shared.connected_components(found.select(F.col("to").alias("u"), F.col("rep").alias("v")))
    per_rep = least.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    per_rep = shared.stash(per_rep.select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "per_rep")
    shared.discard(sent, sizes, found, reps, least, parts)
    component = F.coalesce("component", "vec_id")
    return rows.join(per_rep, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
