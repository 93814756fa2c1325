"""Near-duplicate vectors: spherical k-means cells, and exact cosine products in blocks within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, thinned
from .components import components


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k unit centroids of unit vectors x; a cell that empties takes the vector farthest from its centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        near, new = s.argmax(axis=1), np.zeros_like(c)
        np.add.at(new, near, x)
        size = np.linalg.norm(new, axis=1)
        far = np.argsort(s.max(axis=1))
        new[size < 1e-9] = x[far[: int((size < 1e-9).sum())]]
        c = new / np.linalg.norm(new, axis=1, keepdims=True)
    return c


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _neighbours(sim: np.ndarray, least: float, node_a: np.ndarray, node_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, same: bool) -> dict[str, np.ndarray]:
    """For each vector of a block pair that has links in it: their number, and the smallest node of its component in the pair."""
    near = sim >= least
    if same:
        np.fill_diagonal(near, False)
    n_a = near @ weight_b
    n_b = np.zeros(0, np.int64) if same else weight_a @ near
    nodes = node_a if same else np.concatenate((node_a, node_b))
    offset = 0 if same else len(node_a)
    root = np.full(len(nodes), -1)
    todo = np.flatnonzero(np.concatenate((n_a, n_b)) > 0)
    left_a, left_b = np.ones(len(node_a), bool), np.ones(near.shape[1], bool)
    for start in todo[np.argsort(nodes[todo], kind="stable")].tolist():
        if root[start] >= 0:
            continue
        root[start] = start
        front = [start]
        while front:
            in_a = np.array([f for f in front if same or f < offset], int)
            in_b = np.array([f - offset for f in front if not same and f >= offset], int)
            hit = np.zeros(len(nodes), bool)
            if len(in_a):
                left_a[in_a] = False
                cols = np.flatnonzero(left_b if not same else left_a)
                hit[cols[near[np.ix_(in_a, cols)].any(axis=0)] + offset] = True
            if len(in_b):
                left_b[in_b] = False
                rows = np.flatnonzero(left_a)
                hit[rows[near[np.ix_(rows, in_b)].any(axis=1)]] = True
            hit &= root < 0
            front = np.flatnonzero(hit).tolist()
            root[front] = start
    return {"node": nodes[todo], "links": np.concatenate((n_a, n_b))[todo], "root": nodes[root[todo]]}


def near_duplicates(vectors: DataFrame, least: float = 0.93, cells: int | None = None, cell_rows: int = 8192, sample_rows: int = 4096, block: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; pairs of equal, non-null label with a cosine of `least` or more are linked, all of them.

    Vectors have the cell of their nearest of `cells` centroids of their length (one for about `cell_rows` vectors of that length unless given; spherical k-means
    on a sample of `sample_rows`, those of least hash; lengths beyond the 16 most frequent are one cell each). A vector that lies within the angle arccos(least) of the plane between
    its own centroid and an earlier cell's is also sent to that cell, so that no pair is lost; those that are not are compared within their
    cell alone. Within a label and cell, blocks of `block` vectors meet pair by pair, each pair in a group of its own, so no group grows with
    the input. A block pair returns a count and one edge per vector, never the pairs. Equal vectors of a label are one class: n_links counts
    its other rows and those of linked classes. Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
    link with nothing, as do vectors of different lengths. component_id is the smallest vec_id reachable. Rows with one vec_id are
    one vertex; a row without a vec_id takes part, and its component has the smallest id in it, or none. An empty table gives no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    sound = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.where(sound).withColumn("len", F.size("v"))
    classes = good.groupBy("label", "v", "len").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    # a class is known by its smallest id, one without ids by its hash
    classes = cut(classes.withColumn("node", F.coalesce("first", F.xxhash64("label", "v"))))
    centroids: dict[int, np.ndarray] = {}
    for size, n in [tuple(r) for r in classes.groupBy("len").count().orderBy(F.desc("count"), "len").limit(16).collect()]:
        k = cells or max(1, -(-n // cell_rows))
        if k > 1:
            picked = classes.where(F.col("len") == size).select("v", F.xxhash64("v").alias("h")).where(thinned(F.col("h"), 4 * sample_rows, n)).orderBy("h").limit(sample_rows).collect()
            if picked:
                centroids[size] = spherical_kmeans(_unit([r.v for r in picked]), k)
    reach = float(np.sqrt(max(0.0, 1 - least * least))) + 1e-9

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = {size: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for size, c in centroids.items()}
        for batch in it:
            lens = batch.column(1).to_numpy(zero_copy_only=False)
            all_v = batch.column(0).to_pylist()
            for size in np.unique(lens).tolist():
                at = np.flatnonzero(lens == size)
                x = _unit([all_v[i] for i in at])
                home = np.zeros(len(at), int)
                row, cell = np.arange(len(at)), home
                if (c := centroids.get(size)) is not None:
                    s = x @ c.T
                    home = s.argmax(axis=1)
                    own = s[np.arange(len(at)), home][:, None]
                    go = (own - s <= reach * gaps[size][home] + 1e-7) & (np.arange(len(c))[None] < home[:, None])
                    row, cell = np.nonzero(go)
                    row, cell = np.concatenate((np.arange(len(at)), row)), np.concatenate((home, cell))
                guest = np.arange(len(row)) >= len(at)
                pick = pa.array(at[row])
                unit = pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pick) for j in (2, 1, 3, 4)), pa.array(cell.astype(np.int32)), pa.array(guest), unit], names=["label", "len", "node", "n", "cell", "guest", "unit"])

    kind = vectors.schema[label].dataType.simpleString()
    placed = cut(classes.select("v", "len", "label", "node", "n").mapInArrow(assign, f"label {kind}, len int, node long, n long, cell int, guest boolean, unit binary"))
    sizes = placed.groupBy("label", "len", "cell").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = sizes.select("label", "len", "cell", blocks("homes").alias("nh"), blocks("guests").alias("ng")).where("nh > 0")
    own = F.pmod(F.xxhash64("node", "unit"), F.when(F.col("guest"), F.col("ng")).otherwise(F.col("nh"))).cast("int")
    to_home = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda j: F.when(F.col("guest"), F.struct(j.alias("i"), (-1 - own).alias("j"), F.lit(1).alias("side"))).otherwise(F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own > j).cast("int").alias("side"))))
    to_guests = F.when(~F.col("guest") & (F.col("ng") > 0), F.transform(F.sequence(F.lit(1), F.greatest("ng", F.lit(1))), lambda j: F.struct(own.alias("i"), (-j).alias("j"), F.lit(0).alias("side")))).otherwise(F.slice(to_home, 1, 0))
    dealt = placed.join(sizes, ["label", "len", "cell"]).withColumn("to", F.explode(F.concat(to_home, to_guests)))
    dealt = dealt.select("label", "len", "cell", F.col("to.i").alias("i"), F.col("to.j").alias("j"), F.col("to.side").alias("side"), "node", "n", "unit")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf.i.iloc[0] == pdf.j.iloc[0]
        a, b = (pdf, pdf) if same else (pdf[pdf.side == 0], pdf[pdf.side == 1])
        x, y = (np.frombuffer(b"".join(p.unit), np.float64).reshape(len(p), -1) for p in (a, b))
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype=np.int64)
        return pd.DataFrame(_neighbours(x @ y.T, least, a.node.to_numpy(), b.node.to_numpy(), a.n.to_numpy(), b.n.to_numpy(), same))

    found = cut(dealt.groupBy("label", "len", "cell", "i", "j").applyInPandas(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = classes.join(links, "node", "left").join(linked, "node", "left")
    smallest = cut(of.where("component is not null")).groupBy("component").agg(F.min("first").alias("least"))
    of = of.join(smallest, "component", "left")
    of = of.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("c"), F.lit(True).alias("known"))
    out = rows.withColumn("ok", sound).join(of, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("known"), F.col("c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
