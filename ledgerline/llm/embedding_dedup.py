"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2 c). They are rotated so that the leading coordinates are the
principal directions of a bounded sample, and range-sorted by label and grid cells of width epsilon. A range is cut into
blocks; two blocks meet only if their boxes of leading coordinates are within epsilon. Inside a pair of blocks the sorted
sequences are halved recursively, and pairs of intervals whose boxes are provably farther apart than epsilon are skipped.
Surviving intervals are compared in double precision on the unrotated vectors.

Equal vectors of a label are one class. A pair of blocks returns, for each vector with a link there, its number of linked
rows and one representative of its links' component, never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, table, written

#: Leading dimensions that the grid uses, vectors of the sample that finds them, vectors of a block, and of a leaf of the recursion.
LEADING, SAMPLE, BLOCK, LEAF = 6, 4000, 8192, 256
#: Slack for rounding in boxes, which only ever skip what is surely too far.
SLACK = 1e-6


def unit(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (bytes of doubles, divided by the norm) of rows that can link at all."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, labels, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for v in b.column(2).to_pylist():
                x = np.array([np.nan if t is None else t for t in v or ()], np.float64)
                top = np.abs(x).max(initial=0.0)
                ok = len(x) and np.isfinite(x).all() and top > 0
                x = x / top if ok else x
                out.append((x / np.sqrt((x * x).sum())).tobytes() if ok else None)
            keep = [i for i, v in enumerate(out) if v is not None]
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array([ids[i] for i in keep], pa.int64()), "label": pa.array([labels[i] for i in keep], pa.string()), "v": pa.array([out[i] for i in keep], pa.binary())})

    rows = vectors.where("label is not null and vec_id is not null and embedding is not null")
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, label string, v binary")


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def axes(classes: DataFrame, size: int) -> np.ndarray:
    """Principal directions of the SAMPLE vectors with the smallest hashes; any rotation gives right results, this one skips most."""
    own, place = classes.where(F.length("v") == size).select("v"), F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    # about four times as many as asked for go on to the ranking, however many there are
    rows = own.where(place < F.lit(int(4 * SAMPLE * (1 << 30) / max(1, own.count())))).orderBy(place, "v").limit(SAMPLE).collect()
    if not rows:
        return np.eye(size // 8)[:, :LEADING]
    x = matrix([bytes(r.v) for r in rows])
    return np.ascontiguousarray(np.linalg.svd(x - x.mean(0), full_matrices=False)[2].T[:, :LEADING])


def cells(classes: DataFrame, turn: np.ndarray, eps: float) -> DataFrame:
    """classes with c0, c1, ...: grid cells of the leading coordinates."""
    n = turn.shape[1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                grid = np.floor(matrix(b.column(2).to_pylist()) @ turn / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(grid[:, i]) for i in range(n))], names=[*b.schema.names, *(f"c{i}" for i in range(n))])

    return classes.select("rep", "label", "v", "n").mapInArrow(run, "rep long, label string, v binary, n long, " + ", ".join(f"c{i} int" for i in range(n)))


def blocks(sorted_rows: DataFrame, turn: np.ndarray, eps: float) -> DataFrame:
    """block, label, lo and hi (box of leading coordinates), reps, ns, vs: runs of at most BLOCK rows of one label."""
    n = turn.shape[1]

    def run(batches):
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def close():
            nonlocal seq, held
            x = matrix([r[2] for r in held]) @ turn
            out = {"block": [part * (1 << 32) + seq], "label": [held[0][1]], "lo": [x.min(0).tolist()], "hi": [x.max(0).tolist()], "reps": [[r[0] for r in held]], "ns": [[r[3] for r in held]], "vs": [b"".join(r[2] for r in held)]}
            seq, held = seq + 1, []
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (held[-1][1] != r[1] or len(held) >= BLOCK):
                    yield close()
                held.append(r)
        if held:
            yield close()

    parts = int(sorted_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", *(f"c{i}" for i in range(n)), "rep"]
    ranged = sorted_rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("rep", "label", "v", "n")
    return ranged.mapInArrow(run, "block long, label string, lo array<double>, hi array<double>, reps array<long>, ns array<long>, vs binary")


def join_sequences(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, eps: float, cosine: float, same: bool):
    """Index pairs (i, j) with x[i] . y[j] >= cosine, by halving the sequences; of a sequence with itself, i < j."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c >= b and a >= d or b <= a or d <= c:
            continue
        if same and a > c:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > (eps + SLACK) ** 2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        m, k = (a + b) // 2 if b - a > LEAF else b, (c + d) // 2 if d - c > LEAF else d
        if same and a == c and b == d:
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        else:
            todo += [(p, q, r, s) for p, q in ((a, m), (m, b)) for r, s in ((c, k), (k, d))]


def unite(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j pairwise; low is the smallest index of each component, before and after."""
    while True:
        a, b = low[i], low[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (next_ := low[low]).tobytes() != low.tobytes():
            low[:] = next_


def linked(pairs: DataFrame, turn: np.ndarray, eps: float, cosine: float) -> DataFrame:
    """(rep, links, root) for each class with a link in a pair of blocks."""

    def one(r: dict):
        same = r["block"] == r["other"]
        x = np.frombuffer(r["vs"], np.float64).reshape(len(r["reps"]), -1)
        y = x if same else np.frombuffer(r["vs2"], np.float64).reshape(len(r["reps2"]), -1)
        if x.shape[1] != y.shape[1]:
            return {}, {}
        ids = np.array(r["reps"] + ([] if same else r["reps2"]))
        ns = np.array(r["ns"] + ([] if same else r["ns2"]))
        off, links, low = 0 if same else len(x), np.zeros(len(ids), np.int64), np.arange(len(ids))
        seen = np.zeros(len(ids), bool)

        for i, j in join_sequences(x, y, x @ turn, y @ turn, eps, cosine, same):
            j = j + off
            np.add.at(links, i, ns[j])
            np.add.at(links, j, ns[i])
            seen[i] = seen[j] = True
            unite(low, i, j)
        at = np.flatnonzero(seen)
        return ids[at], links[at], ids[low[at]]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                got = one(b.slice(i, 1).to_pylist()[0])
                if len(got) == 3:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("rep", "links", "root"), got, strict=True)})

    return pairs.mapInArrow(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of equal, non-null label link if the cosine of their embeddings, in double precision, is at least `cosine`. Null and
    zero vectors, and such with null or non-finite components, link with nothing; so do vectors of different lengths. A
    vec_id that occurs more than once is one node, whose links are those of all its rows; each row is returned. Rows with
    a null vec_id are returned without links and not kept. Vectors may be of any length, the empty one links with nothing; equal
    vectors are linked like others. Further columns are ignored, of whatever name; an empty table gives an empty result.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    spark = vectors.sparkSession
    rows = written(unit(vectors), "units")
    classes = written(rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    sizes = [r.s for r in classes.select(F.length("v").alias("s")).distinct().collect()]  # lengths of vectors: one in practice
    found = spark.createDataFrame([], "rep long, links long, root long")
    for size in sizes:
        turn = axes(classes, size)
        own = classes.where(F.length("v") == size)
        cut = written(blocks(cells(own, turn, eps), turn, eps), "blocks")
        box = cut.select("block", "label", "lo", "hi")
        other = box.select(F.col("block").alias("other"), "label", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        # boxes: one small row for each BLOCK vectors, met on the label and the cell interval of the first coordinate
        step = lambda lo, hi: F.explode(F.sequence(F.floor(lo[0] / eps - 1).cast("long"), F.floor(hi[0] / eps + 1).cast("long")))
        near = box.withColumn("c", step(F.col("lo"), F.col("hi"))).join(other.withColumn("c", step(F.col("lo2"), F.col("hi2"))), ["label", "c"]).where("block <= other")
        gap = F.aggregate(F.arrays_zip("lo", "hi", "lo2", "hi2"), F.lit(0.0), lambda t, g: t + F.pow(F.greatest(F.lit(0.0), g["lo"] - g["hi2"], g["lo2"] - g["hi"]), F.lit(2.0)))
        near = near.where(gap <= (eps + SLACK) ** 2).select("block", "other").distinct()
        left, right = cut.select("block", "reps", "ns", "vs"), cut.select(F.col("block").alias("other"), F.col("reps").alias("reps2"), F.col("ns").alias("ns2"), F.col("vs").alias("vs2"))
        found = found.unionByName(linked(near.join(left, "block").join(right, "other").select("block", "other", "reps", "ns", "vs", "reps2", "ns2", "vs2"), turn, eps, cosine))
    found = written(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = written(rows.join(classes, ["label", "v"]).join(links, "rep", "left").select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "members")
    label = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(own.select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))))
    per = own.groupBy("vec_id").agg(F.sum("links").alias("links"))
    out = vectors.select(F.col("vec_id").cast("long")).join(per, "vec_id", "left").join(label, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, "embeddings", sf_dir))
