"""MinHash near-duplicate removal with HyperMinHash sketches.

Each text's distinct k-word shingles fall into REGISTERS buckets by hash; a register keeps the leading-zero count of the
bucket's smallest hash and MANTISSA bits behind its first one-bit. Registers of empty buckets, and only these, borrow from
another bucket of the same text, chosen by a fixed random order, so that two registers agree with probability near the
Jaccard similarity also for tiny texts. Bands of ROWS compressed registers propose pairs; the collision-corrected estimate drops hopeless
ones; every link is confirmed on the full shingle sets.

A band bucket is never expanded into all its pairs. Texts with the same shingle set are one class. First each class is
verified against the best hub (smallest class in a band bucket) it meets. Then only buckets that still hold more than one
component are searched exhaustively, in blocks, for pairs between components: links inside a component change nothing. The
sketches alone first gather components into clusters that may be linked; then the full sets of a cluster's texts, each sent
once for each block it meets, decide. Neither search returns its pairs, only what joins components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, mix, shingle_sets, slabs, table, written

REGISTERS, ROWS, MANTISSA = 128, 4, 10
#: Expected share of equal registers of two disjoint sets of the same size, times 2**MANTISSA.
COLLISION = 0.1699
#: How far below the threshold an estimate may lie and its pair still be verified: 4.5 standard deviations at 128 registers.
MARGIN = 0.16
#: Rows of a bucket or cluster that one block of the exhaustive search holds, and shingles of them where full sets are held.
BLOCK, SHINGLES = 1000, 1 << 20
BAND = np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

_order = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1).astype(np.int16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS uint16 for each sorted, non-empty set of 64-bit hashes."""
    shift = np.uint64(64 - (REGISTERS.bit_length() - 1))
    cuts = np.arange(REGISTERS, dtype=np.uint64) << shift
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, cuts)
        full = np.append(at[1:], len(s)) > at
        if not full.all():
            own = np.arange(REGISTERS)
            at = at[np.where(full, own, _order[own, np.argmax(full[_order], axis=1)])]
        least[i] = s[at]
    rest = (least << np.uint64(REGISTERS.bit_length() - 1)) | np.uint64(1)  # the bits that did not pick the bucket; never 0
    top = np.frexp(rest.astype(np.float64))[1] - 1
    top = np.where(rest >> np.minimum(top, 63).astype(np.uint64) == 0, top - 1, top).astype(np.uint64)
    zeros = np.uint64(63) - top
    tail = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | tail).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), -1)  # four 16-bit registers are one word
    return mix(words + BAND).view(np.int64)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the equality expected of chance collisions."""
    ratio = n / np.maximum(m, 1)
    c = COLLISION * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return (equal - c) / (1 - c)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set; null if empty), regs."""

    def run(batches):
        for rows, data, offsets in slabs(batches, "text"):
            sets = shingle_sets(data, offsets, k)
            full = [s for s in sets if len(s)]
            regs = iter(registers(full))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "regs": pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, regs binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(band, rep) for each band of each class."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = bands(regs)
                yield pa.RecordBatch.from_pydict({"band": pa.array(keys.ravel()), "rep": pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]))})

    return reps.select("rep", "regs").mapInArrow(run, "band long, rep long")


def best_hubs(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Of pairs (rep, hub): for each rep the hub of the highest estimate that is at least `least`."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                est = estimate((x == y).mean(1), b.column(4).to_numpy(), b.column(5).to_numpy())
                ok = est >= least
                yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(pa.array(ok)), "b": b.column(1).filter(pa.array(ok)), "est": pa.array(est[ok])})

    x = reps.select(F.col("rep"), F.col("regs").alias("r1"), F.col("n").alias("n1"))
    y = reps.select(F.col("rep").alias("hub"), F.col("regs").alias("r2"), F.col("n").alias("n2"))
    scored = pairs.join(x, "rep").join(y, "hub").select("rep", "hub", "r1", "r2", "n1", "n2").mapInArrow(run, "a long, b long, est double")
    return scored.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))


def blocks(rows: DataFrame, group: str, weight: Column) -> DataFrame:
    """rows (group, rep, comp) dealt to block pairs: with i, j, left and same, so that all pairs of different components meet.

    Rows of a group's largest component are dealt into blocks of about weight 1, and so are its other rows; each block of others
    meets every block once. The largest component is not compared with itself, so a huge group costs its size times the
    number of stragglers.
    """
    sizes = rows.groupBy(group, "comp").agg(F.sum(weight).alias("n"))
    sizes = sizes.groupBy(group).agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("major"), F.max("n").alias("nc"), F.sum("n").alias("nu"))
    sizes = sizes.select(group, "major", F.ceil("nc").cast("int").alias("nc"), F.greatest(F.lit(1), F.ceil(F.col("nu") - F.col("nc") - 1e-6)).cast("int").alias("nu"))
    rows = rows.join(sizes, group).withColumn("minor", F.col("comp") != F.col("major"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("nu")).otherwise(F.col("nc"))).cast("int"))
    left = F.transform(F.filter(F.sequence(F.lit(0), F.col("nc") + F.col("nu") - 1), lambda j: (j < F.col("nc")) | (j - F.col("nc") >= F.col("c"))), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    right = F.when(F.col("c") > 0, F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(i.alias("i"), (F.col("nc") + F.col("c")).alias("j"), F.lit(False).alias("left"))))
    major = F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda i: F.struct(i.alias("i"), F.col("c").alias("j"), F.lit(False).alias("left")))
    to = F.when(F.col("minor"), F.concat(left, F.coalesce(right, F.array().cast("array<struct<i:int,j:int,left:boolean>>")))).otherwise(major)
    return rows.withColumn("to", F.explode(to)).select(group, "to.i", "to.j", "to.left", (F.col("to.j") == F.col("nc") + F.col("to.i")).alias("same"), "rep", "comp")


class Forest:
    """Union-find over labels; join() tells whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def by_block(read, solve):
    """Arrow batches sorted by a key of three columns to the pairs that solve() finds in the rows of each key."""

    def run(batches):
        key, held = None, []
        for b in batches:
            for row in read(b):
                if row[:3] != key:
                    if held:
                        yield pairs(solve(held))
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield pairs(solve(held))

    def pairs(found):
        return pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return run


def similar(lo: list[tuple], hi: list[tuple], least: float):
    """For each row of lo, (rep, comp, n, regs, ...), with the rows of hi of other components whose estimate is high enough."""
    comps, ns = np.array([r[1] for r in hi]), np.array([r[2] for r in hi])
    regs = np.frombuffer(b"".join(r[3] for r in hi), np.uint16).reshape(-1, REGISTERS)
    for r in lo:
        est = estimate((regs == np.frombuffer(r[3], np.uint16)).mean(1), np.full(len(ns), r[2]), ns)
        for j in np.flatnonzero((est >= least) & (comps != r[1])).tolist():
            yield r, hi[j]


def sides(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The two sides of a block pair from rows (left, same, ...)."""
    lo = [r[2:] for r in rows if r[0]]
    return lo, lo if rows[0][1] else [r[2:] for r in rows if not r[0]]


def crossing(band: DataFrame, labels: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(u, v): components with rows that share a band and have an estimate of at least `least`; of each block, a spanning forest only."""
    rows = band.join(labels, band.rep == labels.node, "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = rows.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    rows = written(rows.join(mixed, "band", "left_semi"), "mixed")
    dealt = blocks(rows, "band", F.lit(1 / BLOCK)).join(reps, "rep").select("band", "i", "j", "left", "same", "rep", "comp", "n", "regs")
    parts = int(band.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(rows):
        lo, hi = sides(rows)
        forest = Forest()
        return [(x[1], y[1]) for x, y in similar(lo, hi, least) if forest.join(x[1], y[1])] if lo and hi else []

    run = by_block(lambda b: zip(*(c.to_pylist() for c in b.columns), strict=True), solve)
    return dealt.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "u long, v long")


def settled(clusters: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """(u, v): links between components of one cluster, confirmed on full shingle sets; of each block, a spanning forest only.

    clusters: (node, component) over components that may be linked.
    """
    labelled = reps.select("rep", "n").join(labels, reps.rep == labels.node, "left").select("rep", "n", F.coalesce("component", "rep").alias("comp"))
    rows = written(labelled.join(clusters, labelled.comp == clusters.node).select(F.col("component").alias("cluster"), "rep", "comp", "n"), "clustered")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    dealt = blocks(rows, "cluster", F.greatest(F.lit(1 / BLOCK), F.col("n") / SHINGLES)).drop("n").join(reps, "rep").join(texts, "rep").select("cluster", "i", "j", "left", "same", "rep", "comp", "n", "regs", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(b):
        for rows, data, offsets in slabs([b], "text"):
            yield from zip(*(c.to_pylist() for c in rows.columns[:9]), shingle_sets(data, offsets, k), strict=True)

    def solve(rows):
        lo, hi = sides(rows)
        forest, found = Forest(), []
        for x, y in similar(lo, hi, least) if lo and hi else ():
            if forest.find(x[1]) != forest.find(y[1]):
                both = len(np.intersect1d(x[4], y[4], assume_unique=True))
                if 100 * both >= percent * (len(x[4]) + len(y[4]) - both):
                    forest.join(x[1], y[1])
                    found.append((x[0], y[0]))
        return found

    return dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(by_block(read, solve), "u long, v long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids, those with 100 * intersection >= percent * union of their full shingle sets, as (u, v).

    A hub b is sent once for every 4096 of its partners and read before them, so neither a hub's text nor its partners
    pile up in one task. Rows that share a doc_id with different texts are each compared.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / 4096).cast("int").alias("salts"))
    pairs = pairs.join(size, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int"))
    hubs = pairs.select("b", "salt", F.col("b").alias("doc_id"), F.lit(0).alias("member")).distinct()
    both = hubs.unionByName(pairs.select("b", "salt", F.col("a").alias("doc_id"), F.lit(1).alias("member")))
    both = texts.join(both.hint("shuffle_hash"), "doc_id")  # texts are not sorted for it
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        key, hub = None, []
        for rows, data, offsets in slabs(batches, "text"):
            sets, out = shingle_sets(data, offsets, k), []
            for b, salt, doc, member, s in zip(*(rows.column(i).to_pylist() for i in range(4)), sets, strict=True):
                if (b, salt) != key:
                    key, hub = (b, salt), []
                if not member:
                    hub.append(s)
                    continue
                for h in hub:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(h) + len(s) - both):
                        out.append((doc, b))
                        break
            yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    both = both.select("b", "salt", "doc_id", "member", "text").repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "member", "doc_id")
    return both.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts link if 100 * intersection >= percent * union of their distinct k-word shingles; of texts of any length the whole
    set counts. Null, empty and blank texts have no shingles and link with nothing. A doc_id that occurs more than once is one
    node; each of its rows is returned. A null doc_id links with nothing and is not kept. Of equal texts, and of equal
    similarities, the smallest doc_id leads. Further columns are ignored, of whatever name. An empty table gives an empty result.
    """
    least = percent / 100 - MARGIN
    rows = written(sketch(docs, k), "sketches")
    known = rows.where("digest is not null and doc_id is not null")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    # one class per smallest doc_id, also if rows with one doc_id have several texts
    same = known.join(reps.select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    reps = written(reps.select("rep", "n", "regs"), "classes")
    band = written(band_rows(reps).distinct(), "bands")
    hubs = band.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("hi")).where("hub < hi").select("band", "hub")
    stars = band.join(hubs, "band").where("rep <> hub").select("rep", "hub").distinct()
    first = written(best_hubs(stars, reps, least), "stars")
    links = written(confirmed(first, docs, k, percent), "links")
    labels = written(components(links), "labels")
    clusters = written(components(crossing(band, labels, reps, least)), "clusters")
    if not clusters.isEmpty():
        links = links.unionByName(written(settled(clusters, labels, reps, docs, k, percent, least), "links"))
    labels = written(components(links.unionByName(same)), "labels")
    out = rows.join(labels, rows.doc_id == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, "documents", sf_dir), k=3, percent=85)
