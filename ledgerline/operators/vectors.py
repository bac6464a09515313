"""Search among vectors by cosine: exact, with bounds that skip blocks, and through an index that is written once.

Both work on Arrow batches of rows by matrix products. Requests go to the tasks as a matrix, in blocks whose bytes are
checked; only each task's best k of each request leave it.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of request vectors that are sent to every task at once; more requests are searched in several passes.
BLOCK_BYTES = 64 << 20
#: Scores that one matrix product makes.
CELLS = 1 << 21
#: Scores have six decimal places, so that sums in another order give the same ranks.
PLACES = 1_000_000
#: Vectors of a copy that fit an index: k-means and the number of probes are fitted on at most so many, those of smallest hash; and lists of an index.
SAMPLE, LISTS = 20_000, 4096
#: Of the sample, so many vectors are searched for to find how many lists must be probed, for this share of their true neighbours.
TRIALS, RECALL = 400, 0.98

FOUND = "query_id string, chunk_id string, score double"


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column one behind the other, in double precision, and where each row starts. Null lists and values count as empty and as NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64())
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: which rows have a vector with a direction, and those vectors with norm 1. Null, zero and non-finite vectors have none."""
    values, offsets = rows_of(column)
    sizes = np.diff(offsets)
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        v = values[offsets[at][:, None] + np.arange(dim)]
        with np.errstate(all="ignore"):
            norm = np.sqrt((v * v).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            v = v[ok] / norm[ok, None]
        out[dim] = at[ok], v
    return out


def points(x: np.ndarray) -> np.ndarray:
    """Scores in whole units of the last place, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) * PLACES + 0.5)).astype(np.int64)


class Best:
    """The best k rows so far of each of n requests, and the score that a row must reach to be among them."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.held, self.size, self.settled = n, k, [], 0, False
        self.least = np.full(n, -2 * PLACES, np.int64)

    def add(self, requests: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: whole points of rows by requests."""
        bound = self.least[requests]
        if len(ids) > self.k:
            bound = np.maximum(bound, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, col = np.nonzero(scores >= bound)
        if len(row):
            self.held.append((requests[col], scores[row, col], ids[row]))
            self.size, self.settled = self.size + len(row), False
            if self.size > 4 * self.n * self.k + 10_000:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        if self.settled:
            return self.held[0]
        req, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        by = np.lexsort((ids.astype(str), -score, req))
        req, score, ids = req[by], score[by], ids[by]
        first = np.searchsorted(req, np.arange(self.n))
        place = np.arange(len(req)) - first[req]
        self.least[req[place == self.k - 1]] = score[place == self.k - 1]
        kept = place < self.k
        self.held, self.size, self.settled = [(req[kept], score[kept], ids[kept])], int(kept.sum()), True
        return self.held[0]


def compare(best: Best, q: np.ndarray, requests: np.ndarray, v: np.ndarray, ids: np.ndarray) -> int:
    """Scores the vectors v against the requests (rows `requests` of q) wherever they can matter; returns how many pairs were scored.

    If there are more requests than that costs, the rows are dealt to the nearest of about a square root of them, the pivots. An angle
    between unit vectors keeps the triangle inequality, so no row of a block is nearer to a request than their angle to the pivot
    less the block's radius: requests that have k better rows already skip the block.
    """
    done, pivots = 0, int(np.sqrt(len(v)))
    if len(requests) <= 2 * pivots or len(v) < 64:
        step = max(best.k + 1, CELLS // max(1, len(requests)))
        for a in range(0, len(v), step):
            best.add(requests, ids[a : a + step], points(v[a : a + step] @ q[requests].T))
            best.settle()
            done += len(requests) * len(v[a : a + step])
        return done
    centres = v[:: -(-len(v) // pivots)]
    near = v @ centres.T
    own = near.argmax(1)
    angle = np.arccos(np.clip(near[np.arange(len(v)), own], -1, 1))
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(len(centres) + 1))
    to_pivot = np.arccos(np.clip(q[requests] @ centres.T, -1, 1))
    done += to_pivot.size
    for p in np.argsort(np.median(to_pivot, axis=0)):
        block = order[bounds[p] : bounds[p + 1]]
        if not len(block):
            continue
        closest = np.cos(np.maximum(to_pivot[:, p] - angle[block].max() - 1e-9, 0))
        asked = requests[points(closest) + 1 >= best.least[requests]]
        step = max(1, CELLS // len(block))
        for a in range(0, len(asked), step):
            part = asked[a : a + step]
            best.add(part, ids[block], points(v[block] @ q[part].T))
            done += len(part) * len(block)
        best.settle()
    return done


def request_blocks(requests: DataFrame, filters: tuple[str, ...]) -> Iterator[pa.Table]:
    """The requests in blocks of about BLOCK_BYTES, by hash."""
    q = requests.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), *filters).where("embedding is not null")
    sent = q.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    blocks = 1 + sent // BLOCK_BYTES
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        yield part.toArrow()


def keys_of(batch, filters: tuple[str, ...]) -> list[tuple]:
    return list(zip(*(batch.column(f).to_pylist() for f in filters), strict=True)) if filters else [()] * batch.num_rows


def exact(requests: DataFrame, chunks: DataFrame, k: int, filters: tuple[str, ...] = (), counter=None) -> DataFrame:
    """query_id, chunk_id, score of each task's best k chunks of each request, of those whose filter columns equal the request's (null equals nothing).

    counter: an accumulator that gets the number of pairs whose score was computed.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding", *filters).where("embedding is not null")
    out = None
    for block in request_blocks(requests, filters):
        if not block.num_rows:
            continue
        # matrices by dimension, and in each the rows by filter values
        keys, matrices, where = keys_of(block, filters), {}, {}
        names = block.column("query_id").to_pylist()
        for dim, (at, q) in units(block.column("embedding")).items():
            groups = defaultdict(list)
            for i, row in enumerate(at.tolist()):
                if None not in keys[row]:
                    groups[keys[row]].append(i)
            matrices[dim] = q, [names[i] for i in at.tolist()]
            where[dim] = {key: np.array(g) for key, g in groups.items()}
        sent = spark.sparkContext.broadcast((matrices, where))

        def run(batches, sent=sent):
            matrices, where = sent.value
            best = {dim: Best(len(q), k) for dim, (q, _) in matrices.items()}
            for b in batches:
                ids, keys = np.array(b.column("chunk_id").to_pylist(), object), keys_of(b, filters)
                for dim, (at, v) in units(b.column("embedding")).items():
                    if dim not in matrices:
                        continue
                    groups = defaultdict(list)
                    for i, row in enumerate(at.tolist()):
                        groups[keys[row]].append(i)
                    for key, own in groups.items():
                        asked = where[dim].get(key)
                        if asked is not None:
                            n = compare(best[dim], matrices[dim][0], asked, v[own], ids[at[own]])
                            if counter is not None:
                                counter.add(n)
            for dim, found in best.items():
                req, score, ids = found.settle()
                names = matrices[dim][1]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([names[i] for i in req.tolist()], pa.string()), "chunk_id": pa.array(ids.tolist(), pa.string()), "score": pa.array(score / PLACES)})

        part = rows.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each request with their rank; of equal scores the smallest chunk_id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


# A stored index


def centres_of(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means on directions, from rows spread over v; a centre without rows takes the row that fits its centre least."""
    c = v[np.linspace(0, len(v) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = v @ c.T
        own = near.argmax(1)
        fit = near[np.arange(len(v)), own]
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        for empty in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            worst = int(fit.argmin())
            total[empty], fit[worst] = v[worst], 2
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def probes_for(v: np.ndarray, c: np.ndarray, k: int) -> int:
    """Least number of lists that hold RECALL of the k nearest of the first TRIALS vectors, in the sample itself."""
    own, asked = (v @ c.T).argmax(1), v[:TRIALS]
    score = asked @ v.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -2
    true = np.argsort(-score, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)  # of each list, for each vector
    needed = np.sort(place[np.arange(len(asked))[:, None], own[true]].ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1 if len(needed) else 1


def build_index(chunks: DataFrame, path: str, lists: int | None = None, k: int = 5) -> None:
    """Writes an inverted-file index of chunks (chunk_id, embedding) to the new folder `path`.

    Lists are cells of a k-means over directions, fitted on SAMPLE vectors at most; there are about a square root of the rows', LISTS
    at most, and every row with a direction is in one. A list is one Parquet partition, which holds ids, vectors and their
    residuals to the centre in one byte a dimension. The number of lists to probe is what the sample needs for RECALL. Vectors of
    another dimension than most of the sample's are not indexed: search() gives none of them.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n = rows.count()
    share = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < 2_000_000 * SAMPLE // n)
    sample = share.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).toArrow()
    by_dim = units(sample.column("embedding"))
    dim, (_, v) = max(by_dim.items(), key=lambda x: len(x[1][0]), default=(0, (None, np.zeros((0, 0)))))
    count = max(1, min(LISTS, len(v), lists or round(np.sqrt(n))))
    c = centres_of(v, count) if len(v) else np.zeros((1, dim))
    residual = np.abs(v - c[(v @ c.T).argmax(1)]).max(0) if len(v) else np.ones(dim)
    scale = np.where(residual > 0, residual, 1) / 127
    sent = spark.sparkContext.broadcast((dim, c, scale))

    def run(batches):
        dim, c, scale = sent.value
        for b in batches:
            at, v = units(b.column("embedding")).get(dim, (np.zeros(0, int), None))
            if not len(at):
                continue
            own = np.concatenate([(v[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(v), 4096)])
            code = np.clip(np.rint((v - c[own]) / scale), -127, 127).astype(np.int8)
            flat = pa.py_buffer(np.ascontiguousarray(code))
            codes = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * dim).astype(np.int32)), flat])
            vectors = pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * dim).astype(np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_pydict({"list": pa.array(own.astype(np.int32)), "chunk_id": b.column("chunk_id").take(pa.array(at)), "code": codes, "unit": vectors})

    dealt = rows.mapInArrow(run, "list int, chunk_id string, code binary, unit array<double>").hint("rebalance", "list")
    dealt.write.partitionBy("list").parquet(f"{path}/rows")
    about = json.dumps({"dim": int(dim), "probes": probes_for(v, c, k) if len(v) else 1, "centres": c.ravel().tolist(), "scale": scale.tolist()})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/about")  # last: an index without it is not whole


def about(spark: SparkSession, path: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Dimension, probes, centres and scale of an index: a table of LISTS rows at most."""
    d = json.loads(spark.read.parquet(f"{path}/about").first().about)
    return d["dim"], d["probes"], np.array(d["centres"]).reshape(-1, max(1, d["dim"])), np.array(d["scale"])


def in_lists(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """The index's rows in the given lists; only their partitions are read."""
    return spark.read.schema("chunk_id string, code binary, unit array<double>, list int").parquet(f"{path}/rows").where(F.col("list").isin(lists))


def search(requests: DataFrame, path: str, k: int = 5, probes: int | None = None, keep: int = 4) -> DataFrame:
    """query_id, chunk_id, score of the best k rows of an index for each request: by codes among the nearest lists, `keep` times k, then by the vectors.

    A request probes as many lists as the index was fitted for, or `probes`, and more until they hold k rows. Requests without a
    direction, or of another dimension, find nothing.
    """
    spark = requests.sparkSession
    dim, fitted, c, scale = about(spark, path)
    if not dim:
        return spark.createDataFrame([], FOUND)
    sizes = {r.list: r.n for r in spark.read.schema("list int").parquet(f"{path}/rows").groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS rows at most
    n = np.array([sizes.get(i, 0) for i in range(len(c))])
    out = None
    for block in request_blocks(requests, ()):
        at, q = units(block.column("embedding")).get(dim, (np.zeros(0, int), None))
        if not len(at):
            continue
        names = [block.column("query_id")[i].as_py() for i in at.tolist()]
        order = np.argsort(-(q @ c.T), axis=1)
        ahead = np.cumsum(n[order], axis=1) - n[order]
        probed = (np.arange(len(c)) < (probes or fitted)) | (ahead < k)
        asked = {i: np.flatnonzero((probed & (order == i)).any(1)) for i in range(len(c)) if n[i]}
        asked = {i: rows for i, rows in asked.items() if len(rows)}
        rows = in_lists(spark, path, sorted(asked))
        sent = spark.sparkContext.broadcast((q, c, scale, asked, names))

        def by_code(batches, sent=sent):
            q, c, scale, asked, names = sent.value
            best = Best(len(q), k * keep)
            for b in batches:
                lists, ids = b.column("list").to_numpy(), np.array(b.column("chunk_id").to_pylist(), object)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(-1, len(scale))
                for i in np.unique(lists).tolist():
                    at, rows = np.flatnonzero(lists == i), asked[i]
                    for a in range(0, len(at), max(1, CELLS // len(rows))):
                        part = at[a : a + max(1, CELLS // len(rows))]
                        best.add(rows, np.array([f"{i} {x}" for x in ids[part]], object), points((c[i] + code[part] * scale) @ q[rows].T))
                best.settle()
            req, score, ids = best.settle()
            split = [x.split(" ", 1) for x in ids.tolist()]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([names[i] for i in req.tolist()], pa.string()), "list": pa.array([int(x[0]) for x in split], pa.int32()), "chunk_id": pa.array([x[1] for x in split], pa.string()), "near": pa.array(score / PLACES)})

        near = rows.select("list", "chunk_id", "code").mapInArrow(by_code, "query_id string, list int, chunk_id string, near double")
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id")
        near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k * keep).select("query_id", "list", "chunk_id")
        asking = spark.createDataFrame(pa.table({"query_id": names, "q": list(q)}))
        found = near.join(rows.select("list", "chunk_id", "unit"), ["list", "chunk_id"]).join(asking, "query_id")
        part = found.select("query_id", "chunk_id", F.round(dot("q", "unit"), 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return ranked(out, k) if out is not None else ranked(spark.createDataFrame([], FOUND), k)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
