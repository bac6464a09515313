"""Helpers that several operators share: written intermediate tables, connected components and byte-level word scanning."""

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A byte to its lower case, for A-Z only (bytes of longer UTF-8 characters stay).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that make up letters-and-digits words; every byte of a non-ASCII character does.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[97:123] = WORDLIKE[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, spark.checkpoint.dir. Where that is unset, a temporary folder serves local mode; a cluster gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-"))
        root = _local[0]
    return f"{root}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lets the session send texts to Python in Arrow batches of a few megabytes: 10,000 long texts at once take more memory than the work on them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table written to the shared folder: lineage ends there, and a lost executor costs nothing done before."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v) by alternating large-star and small-star steps.

    Returns node, component (smallest node reachable) for every node that has an edge. Each round is joins and map-side
    combined minima, so the edges of a hub are never gathered in one task; AQE splits the hub's join partition. Null ends
    and self loops are ignored; without edges the result is empty.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, last = written(e, "edges"), None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last or not mark.n:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = written(small.where("u <> v").distinct(), "edges")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64; those of usual sizes are remembered."""
    if len(_powers.get("up", ())) <= n:
        made = {}
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
            steps[0] = 1
            made[name] = np.cumprod(steps, dtype=np.uint64)
        if n > 2 << 20:
            return made["up"][: n + 1], made["down"][: n + 1]
        _powers.update(made)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * base**position over data[i:j]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix) - 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 512 << 10, rows: int = 256):
    """(first row, past the last, bytes, offsets) of slices of a string column with at most `rows` rows and `limit` bytes (one row may be longer): bounds what is copied and held at once."""
    for start in range(0, len(column), rows):
        data, offsets = binary(column.slice(start, rows))
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield start + i, start + j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def slabs(batches, text: str, limit: int = 512 << 10, rows: int = 256):
    """Arrow batches in such slices by their column `text`."""
    for whole in batches:
        for i, j, data, offsets in slices(whole.column(whole.schema.get_field_index(text)), limit, rows):
            yield whole.slice(i, j - i), data, offsets


def text_column(work, kind: str, fields: pa.StructType, limit: int = 512 << 10, rows: int = 256):
    """A function of a text column. work(texts, data, offsets) gives the arrays of a struct's fields for a slice of texts; only the text goes to Python, and only the struct comes back."""

    @F.arrow_udf(kind)
    def column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            done = [pa.StructArray.from_arrays(work(whole.slice(i, j - i), data, offsets), fields=list(fields)) for i, j, data, offsets in slices(whole, limit, rows)]
            yield pa.concat_arrays(done) if done else pa.array([], fields)

    return column


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the index of each row's first word (with the total last). inside: is byte i part of a word."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each row, the sorted distinct 64-bit hashes of its k-word shingles; with fewer words, the whole sequence as one; without words, none."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, ~SPACE[low])
    h = span_hash(prefix_hash(low), starts, ends)
    n = len(h)
    whole = np.zeros(n, np.uint64)
    if n >= k:
        part = np.zeros(n - k + 1, np.uint64)
        for t in range(k):
            part = mix(part + h[t : n - k + 1 + t] + np.uint64(t + 1))
        whole[: n - k + 1] = part
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            part = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                part = mix(part * np.uint64(31) + x)
            out.append(part)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
