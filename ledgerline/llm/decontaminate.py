"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of benchmark items, each a sequence of words as 64-bit hashes. Patterns of one length share a
table: the hash of a block of two words tells how far the search may jump (the shift table); where it may not, the block
that ends the pattern picks the few patterns to try (the suffix-hash buckets), and these are compared word by word, first
by word hash and then by their bytes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, WORDLIKE, mix, prefix_hash, slabs, span_hash, table, text_column, words, written

WINDOW = 13
#: Windows whose tables are sent to every task at once (about 150 MB at most); more are searched in several passes.
BROADCAST = 200_000


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    starts, ends, first = words(low, offsets, WORDLIKE[low])
    return low, starts, ends, first, span_hash(prefix_hash(low), starts, ends)


def windows(bench: DataFrame, window: int) -> DataFrame:
    """item_id (may be null), pattern (its words, joined by spaces), hashes: one row for each window of each item."""

    def run(batches):
        for rows, data, offsets in slabs(batches, "text"):
            low, starts, ends, first, h = word_hashes(data, offsets)
            out = []
            for item, a, b in zip(rows.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for i in range(a, max(a + 1, b - window + 1) if b > a else a):
                    j = min(i + window, b)
                    out.append((item, b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(i, j)), h[i:j].view(np.int64)))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([x[0] for x in out], pa.int64()), "pattern": pa.array([x[1] for x in out], pa.binary()), "hashes": pa.array([x[2] for x in out], pa.list_(pa.int64()))})

    return bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, pattern binary, hashes array<long>")


class Tables:
    """Shift tables and suffix-hash buckets, one pair for each pattern length."""

    def __init__(self, patterns: list[tuple[bytes, list[int], list[int]]]):
        """patterns: (bytes, word hashes, item ids), distinct."""
        self.by_length = []
        for m in sorted({len(p[1]) for p in patterns}):
            block, shift, bucket = min(2, m), {}, {}
            for text, hashes, items in patterns:
                if len(hashes) != m:
                    continue
                keys = self.keys(np.array(hashes, np.int64).view(np.uint64), block).tolist()
                for j, key in enumerate(keys):
                    shift[key] = min(shift.get(key, m), len(keys) - 1 - j)
                bucket.setdefault(keys[-1], []).append((hashes, text, items))
            self.by_length.append((m, block, m - block + 1, shift, bucket))

    @staticmethod
    def keys(h: np.ndarray, block: int) -> np.ndarray:
        return h if block == 1 else mix(h[:-1] * np.uint64(3) + h[1:])

    def search(self, h: np.ndarray, spelled) -> list[tuple[int, int, list[int]]]:
        """(first word, words, items) of each occurrence in the word hashes h. spelled(i, j): bytes of words i to j - 1."""
        found, plain = [], h.view(np.int64).tolist()
        for m, block, far, shift, bucket in self.by_length:
            if len(plain) < m:
                continue
            keys, at = self.keys(h, block).tolist(), m - block
            while at < len(keys):
                s = shift.get(keys[at], far)
                if s:
                    at += s
                    continue
                i = at - (m - block)
                for hashes, text, items in bucket[keys[at]]:
                    if plain[i : i + m] == hashes and spelled(i, i + m) == text:
                        found.append((i, m, items))
                at += 1
        return found


FOUND = pa.struct([("n_words", pa.int64()), ("at", pa.list_(pa.int32())), ("to", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])

_made: dict[int, Tables] = {}


def finder(spark, patterns: list):
    """A function of a text column that gives the number of words, the runs of words hit (from at to to) and the items found."""
    sent = spark.sparkContext.broadcast(patterns)
    name = sent._jbroadcast.id() if hasattr(sent, "_jbroadcast") else id(sent)

    def work(texts, data, offsets):
        if name not in _made:  # of each worker, for the tasks that follow too
            _made.clear()
            _made[name] = Tables(sent.value)
        low, starts, ends, first, h = word_hashes(data, offsets)
        at, to, items = [], [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            found = _made[name].search(h[a:b], lambda i, j, a=a: b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(a + i, a + j)))
            runs = merged((i, i + m) for i, m, _ in found)
            at.append([x for x, _ in runs])
            to.append([y for _, y in runs])
            items.append(sorted({x for f in found for x in f[2]}))
        return pa.array(np.diff(first), pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(to, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))

    return text_column(work, "n_words long, at array<int>, to array<int>, items array<long>", FOUND)


def merged(runs) -> list[tuple[int, int]]:
    """Runs (i, j) joined where they touch."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(runs):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return out


HIT = "aggregate(arrays_zip(found.at, found.to), 0L, (n, x) -> n + x.to - x.at)"


def shards_of(spark, bench: DataFrame, window: int, broadcast: int):
    """The distinct windows of bench in lists of about `broadcast` at most, one after the other."""
    patterns = windows(bench, window).groupBy("pattern").agg(F.first("hashes").alias("hashes"), F.array_sort(F.collect_set("item_id")).alias("items"))
    many = max(1, -(-patterns.count() // broadcast))
    if many > 1:
        patterns = written(patterns, "patterns")
    for k in range(many):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(many)) == k) if many > 1 else patterns
        yield many, [(bytes(r.pattern), list(r.hashes), list(r["items"])) for r in part.collect()]


def found_in(docs: DataFrame, bench: DataFrame, window: int, broadcast: int) -> DataFrame:
    """docs (with a column text) with a struct column `found`: n_words, n_hit, items."""
    spark, parts = docs.sparkSession, []
    text = F.col("text").cast("string")
    for many, patterns in shards_of(spark, bench, window, broadcast):
        find = finder(spark, patterns)
        if many == 1:
            found = docs.withColumn("found", find(text))
            return found.withColumn("found", F.struct(F.col("found.n_words").alias("n_words"), F.expr(HIT).alias("n_hit"), F.col("found.items").alias("items")))
        # a pass for each list; only what is found is kept, under a 128-bit digest of the text
        passed = docs.select(F.md5(text.cast("binary")).alias("key"), find(text).alias("found")).where("size(found.at) > 0").distinct()
        parts.append(written(passed.selectExpr("key", "arrays_zip(found.at, found.to) as runs", "found.items as items"), "found"))
    count = text_column(lambda texts, data, offsets: [pa.array(np.diff(word_hashes(data, offsets)[3]), pa.int64())], "n_words long", pa.struct([("n_words", pa.int64())]))
    ends = "transform(array_sort(flatten(collect_list(runs))), x -> struct(x.at as at, x.to as to))"
    # the union of sorted runs: what each adds beyond the furthest end before it
    union = "aggregate(runs, struct(0L as n, 0 as far), (s, x) -> struct(s.n + greatest(0, x.to - greatest(x.at, s.far)) as n, greatest(s.far, x.to) as far)).n"
    hits = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.expr(ends).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).selectExpr("key", f"{union} as n_hit", "items")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.md5(text.cast("binary")).alias("key"), count(text)["n_words"].alias("n_words")).join(hits, "key", "left")
    none = F.array().cast("array<bigint>")
    return keyed.select("row.*", F.struct("n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")).alias("found"))


def is_contaminated(per: int = 20):
    return (F.col("found.n_hit") > 0) & (F.col("found.n_hit") * per >= F.col("found.n_words"))


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, per: int = 20, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of docs that are not contaminated, see contamination(), with their columns, of whatever name. Rows are judged each by its own text."""
    return found_in(docs.select("text", F.struct(*docs.columns).alias("row")), bench, window, broadcast).where(~is_contaminated(per)).select("row.*")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, per: int = 20, broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A text is contaminated if it has hit words and at least one word in `per` is hit. Null and empty texts have no words; long
    ones are searched whole. Items without words have no windows; windows of items with a null item_id hit, but no item is
    named for them; several rows of one item_id are one item. Equal windows of several items name all of these. Rows that
    repeat a doc_id are each returned; further columns are ignored, of whatever name; either table may be empty. Windows
    are searched in lists of `broadcast`, one pass over the documents for each.
    """
    out = found_in(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), bench, window, broadcast)
    names = F.array_join(F.array_sort(F.transform("found.items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        is_contaminated(per).alias("contaminated"), F.col("found.items").alias("items"),
    )


def op4_decontamination(spark, sf_dir):
    return contamination(table(spark, "documents", sf_dir), table(spark, "benchmark", sf_dir)).drop("items")
