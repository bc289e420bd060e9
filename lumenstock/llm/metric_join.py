"""Near-duplicate vectors by an exact metric range join over pivot cells.

Cosine >= t of unit vectors is a Euclidean distance <= r = sqrt(2 - 2t). Every vector belongs to the cell of its
nearest pivot. If v of cell h has a partner u in cell j, then by the triangle inequality d(v, p_j) <= d(v, p_h) + 2r,
d(v, p_j) <= radius(j) + r, and v lies within r of the plane between the two pivots; v is copied to every lower cell j
for which all three hold, so each pair meets in one cell. Cells join on their own: a cell is cut into blocks of at
most `block` vectors, and every pair of blocks is a task that multiplies two matrices in double precision. A task
returns the number of partners of each vector and a spanning forest of its links, never its pairs.

Equal vectors are one from the start, with their number, so copies cost nothing and a crowded cell is split by blocks.
Pivots are a sample (for each length at most `max_pivots`, spread by a hash), of which those closer than APART to an
earlier one are left out: scaled copies have one direction, and a plane between two pivots a rounding apart is noise.
Any choice of pivots APART from each other gives the same result.

Vectors that are null, empty or zero, or have null or non-finite components link with nothing, and vectors of
different lengths do not link. Rows without an id are left out; rows that repeat an id are vectors of their own, each
with its own links and component (whose name is still the smallest id in it). An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, stored

SLACK = 1e-6  # of distances: rounding must not lose a copy; near zero the root of 2 - 2cos is off by about 1e-8
APART = 1e-3  # least distance of two pivots, so that the plane between them is known far better than SLACK


def _units(batch_column) -> np.ndarray:
    """Unit vectors, one row each, from bytes of doubles of one length."""
    x = np.array([np.frombuffer(b, "<f8") for b in batch_column])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(p: np.ndarray) -> np.ndarray:
    """The pivots, in order, without those closer than APART to one already taken."""
    left, taken = np.arange(len(p)), []
    while len(left):
        taken.append(left[0])
        left = left[np.linalg.norm(p[left] - p[left[0]], axis=1) >= APART]
    return p[taken]


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine with exactly rounded sums."""
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _cells(pivots: dict[int, np.ndarray], reach: float):
    """Home cell and, for each vector, the lower cells that the plane and the triangle inequality leave."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size = np.array([len(b) // 8 for b in batch.column(2).to_pylist()])
            rows = []
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                p = pivots[int(d)]
                between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                for cut in np.array_split(at, max(1, len(at) * len(p) // 4_000_000)):
                    x = _units([batch.column(2)[int(i)].as_py() for i in cut])
                    far = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
                    home = far.argmin(1)
                    near = far[np.arange(len(x)), home]
                    plane = far ** 2 - near[:, None] ** 2 <= (reach + SLACK) * 2 * between[home]
                    keep = (far <= near[:, None] + 2 * reach + SLACK) & plane & (np.arange(len(p))[None, :] < home[:, None])
                    for k, i in enumerate(cut):
                        others = np.flatnonzero(keep[k])
                        rows.append((int(i), int(home[k]), float(near[k]), others.tolist(), far[k][others].tolist()))
            rows.sort()
            types = [pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows))[1:], types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), *cols], names=["rep", "copies", "vector", "size", "home", "near", "others", "far"])

    return run


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(place, root) for the connected groups of a two-sided graph; right-hand places follow the left-hand ones."""
    rows, columns = links.shape
    left, right, out = np.flatnonzero(links.any(1)), np.zeros(columns, bool), []
    open_rows = np.zeros(rows, bool)
    open_rows[left] = True
    for start in left:
        if not open_rows[start]:
            continue
        open_rows[start] = False
        front = np.array([start])
        while len(front):
            met = links[front].any(0) & ~right
            right |= met
            out += [(rows + int(c), int(start)) for c in np.flatnonzero(met)]
            grown = links[:, met].any(1) & open_rows
            open_rows &= ~grown
            front = np.flatnonzero(grown)
            out += [(int(r), int(start)) for r in front]
    return out


def _join_blocks(threshold: float):
    def run(key, table):
        import pyarrow as pa

        one = key[2].as_py() == key[3].as_py()
        side = table.column("side").to_numpy()
        ids, copies, vectors = table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("vector").to_pylist()
        a = np.flatnonzero(side == 0)
        b = a if one else np.flatnonzero(side == 1)
        if len(a) and len(b):
            x = _units([vectors[i] for i in a])
            y = x if one else _units([vectors[i] for i in b])
            links = np.zeros((len(a), len(b)), bool)
            for at in range(0, len(a), 512):
                cosine = x[at:at + 512] @ y.T
                links[at:at + 512] = cosine >= threshold
                for i, j in np.argwhere(np.abs(cosine - threshold) < 1e-12):
                    links[at + i, j] = _exact(np.frombuffer(vectors[a[at + i]], "<f8"), np.frombuffer(vectors[b[j]], "<f8")) >= threshold
            if one:
                np.fill_diagonal(links, False)
            n = {int(i): 0 for i in ids}
            for i, c in zip(ids[a], links @ copies[b]):
                n[int(i)] += int(c)
            if not one:
                for i, c in zip(ids[b], copies[a] @ links):
                    n[int(i)] += int(c)
            both = np.concatenate([ids[a], ids[b]])
            edges = [(int(both[p]), int(both[q])) for p, q in _forest(links)]
            counts = [(i, c) for i, c in n.items() if c]
        else:
            edges, counts = [], []
        rows = [(a, b, None) for a, b in edges] + [(i, None, c) for i, c in counts]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    return run


def metric_links(vectors: DataFrame, threshold: float = 0.9, per_cell: int = 4096, max_pivots: int = 1024, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (vec_id, rep, copies, first; rep, the number of the class, null for rows that cannot link) and, by rep, partial counts and forest edges (a, b, links)."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL")

    def valid(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for e in batch.column(1).to_pylist():
                x = np.array(e, "<f8") if e and None not in e else np.zeros(0)
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    checked = stored(raw.mapInArrow(valid, "vec_id long, vector binary"), "vectors")
    equal = checked.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    numbered = stored(equal.select(F.monotonically_increasing_id().alias("rep"), "copies", "first", "vector"), "vectors")  # an id may repeat, so it does not name a class
    distinct = numbered.select("rep", "copies", "vector")
    classes = checked.join(numbered, "vector", "left").select("vec_id", "rep", "copies", "first")

    sized = distinct.withColumn("size", F.octet_length("vector")).withColumn("hash", F.xxhash64("vector"))
    first = F.row_number().over(W.partitionBy("size").orderBy("hash", "vector"))
    sample = sized.withColumn("r", first).where(F.col("r") <= 4).select("size", "vector").collect()
    for size, n in sized.groupBy("size").count().where(F.col("count") >= 5 * per_cell).collect():
        more = sized.where(F.col("size") == size).orderBy("hash", "vector").limit(min(max_pivots, n // per_cell))
        sample = [v for v in sample if v[0] != size] + more.select("size", "vector").collect()
    pivots: dict[int, list] = {}
    for size, v in sample:
        pivots.setdefault(size // 8, []).append(bytes(v))
    reach = math.sqrt(2 - 2 * threshold)
    table = {d: _apart(_units(v)) for d, v in pivots.items()}
    placed = stored(distinct.mapInArrow(_cells(table, reach), "rep long, copies long, vector binary, size int, home int, near double, others array<int>, far array<double>"), "cells")
    radius = placed.groupBy("size", F.col("home").alias("cell")).agg(F.max("near").alias("radius"), F.count(F.lit(1)).alias("at_home"))
    spread = placed.select("rep", "copies", "vector", "size", F.explode(F.arrays_zip("others", "far")).alias("o")).select("rep", "copies", "vector", "size", F.col("o.others").alias("cell"), F.col("o.far").alias("far"))
    radius = F.broadcast(radius)  # one row for each pivot
    copied = spread.join(radius.select("size", "cell", "radius"), ["size", "cell"]).where(F.col("far") <= F.col("radius") + reach + SLACK)
    rows = stored(placed.select("rep", "copies", "vector", "size", F.col("home").alias("cell"), F.lit(True).alias("home")).unionByName(copied.select("rep", "copies", "vector", "size", "cell", F.lit(False).alias("home"))), "cells")
    blocks = rows.groupBy("size", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("m"), F.ceil(F.sum((~F.col("home")).cast("int")) / block).cast("int").alias("extra"))
    at = F.when(F.col("home"), F.pmod(F.xxhash64("rep"), "m")).otherwise(F.col("m") + F.pmod(F.xxhash64("rep"), "extra")).cast("int")
    cut = rows.join(F.broadcast(blocks), ["size", "cell"]).withColumn("at", at)  # one row for each pivot
    # A block at home meets all of the cell; a copied block meets the blocks at home.
    meets = F.when(F.col("home"), F.sequence(F.lit(0), F.col("m") + F.col("extra") - 1)).otherwise(F.sequence(F.lit(0), F.col("m") - 1))
    tasks = cut.withColumn("meet", F.explode(meets)).select("rep", "copies", "vector", "size", "cell", F.least("at", "meet").alias("i"), F.greatest("at", "meet").alias("j"), (F.col("at") > F.col("meet")).cast("int").alias("side"))
    found = tasks.groupBy("size", "cell", "i", "j").applyInArrow(_join_blocks(threshold), "a long, b long, links long")
    return classes, stored(found, "vector-links")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id, kept."""
    classes, found = metric_links(vectors, threshold, **options)
    partners = found.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("partners"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = groups.join(classes.select("rep", "first").distinct(), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("first").alias("smallest"))
    groups = groups.join(named, "component").select("node", "smallest")
    out = classes.join(partners, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    links = F.coalesce(F.col("partners"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.coalesce("smallest", "first", "vec_id")
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
