"""Removal of long byte strings that occur more than once, by merging shard Burrows-Wheeler orders.

A full suffix order of the corpus is never built. Every window of WINDOW bytes is represented by its anchor, the window's
smallest hash of GRAM bytes (rightmost if tied); equal windows have equal anchors at equal offsets, so the suffix order
splits into one independent problem for each anchor string. A sample is an anchor occurrence with the run of windows it
represents and their bytes, its context. Contexts that are equal byte for byte are one row with a count.

Of an anchor, the contexts found in all shards start as one interval. The interleave of the shards is refined symbol by
symbol (eight bytes at a time) to the right of the anchor: a round only splits intervals that still hold several contexts,
and a split gives the common prefix of its two neighbours. From there each step to the left is a Burrows-Wheeler step: the
order at offset a + 1 is the order at offset a, stably partitioned by the byte that stands before, and common prefixes
follow from range minima. Suffixes are never sorted anew. Neighbours with a common prefix of WINDOW bytes form a repeated
interval, and their windows are removed.

An anchor with too many contexts for one task is refined before it is merged: its windows are halved by where they start, those
of a half all hold the same stretch around the anchor, and contexts that differ in that stretch share no window of the half. So
each half splits into one merge for each such stretch, and so on until merges are small or windows are told apart as a whole.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary, mix, powers, prefix_hash, slabs, table, written

GRAM = 32
#: Contexts that one merge holds at least, if there are so many; an anchor's contexts stay together.
CHUNK = 8192
#: Contexts that a merge holds at most, if it can be helped: an anchor with more is split by its next symbols.
HOT = 50_000
#: Bytes of one document that are scanned at once.
PIECE = 2 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def samples_of(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, last window and anchor position of each sample. ends: the end of its row for each byte."""
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 4
    _, down = powers(len(data))
    p = prefix_hash(data)
    h = mix((p[GRAM:] - p[:-GRAM]) * down[: len(data) - GRAM + 1])
    low = np.uint64((1 << 28) - 1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    least = sliding_min(key, window - GRAM + 1)
    at = (low - (least & low)).astype(np.int64)
    start = np.arange(len(at))
    ok = start + window <= ends[: len(at)]
    first = ok.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    last = ok.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~ok[1:]
    p0, p1 = np.flatnonzero(first), np.flatnonzero(last)
    return h[at[p0]].view(np.int64), p0, p1, at[p0]


def samples(docs: DataFrame, window: int) -> DataFrame:
    """row, h, digest (of the context), p0, p1 (first and last window), s (anchor), all positions in bytes of the row."""

    def run(batches):
        for rows, data, offsets in slabs(batches, "text"):
            ids = rows.column("row")
            for a in range(0, max(1, len(data) - window + 1), PIECE) if rows.num_rows == 1 else [0]:
                part = data[a : a + PIECE + window - 1] if rows.num_rows == 1 else data
                ends = np.full(len(part), len(part)) if rows.num_rows == 1 else np.repeat(offsets[1:], np.diff(offsets))
                h, p0, p1, s = samples_of(part, ends, window)
                view = memoryview(np.ascontiguousarray(part))
                digest = [hashlib.blake2b(view[x : y + window], digest_size=16).digest() for x, y in zip(p0.tolist(), p1.tolist(), strict=True)]
                of = np.searchsorted(offsets, p0 + a, "right") - 1
                base = a - offsets[of]
                yield pa.RecordBatch.from_pydict({"row": ids.take(pa.array(of)), "h": pa.array(h), "digest": pa.array(digest, pa.binary()), "p0": pa.array(p0 + base), "p1": pa.array(p1 + base), "s": pa.array(s + base)})

    return docs.mapInArrow(run, "row binary, h long, digest binary, p0 long, p1 long, s long")


def interleave(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, symbols) and the common prefix in bytes of each with the one before (-1: first of its group).

    symbols: a row of big-endian 8-byte symbols for each context; group: ascending.
    """
    m, width = symbols.shape
    order, interval = np.arange(m), group.copy()
    head = np.ones(m, bool)
    head[1:] = group[1:] != group[:-1]
    lcp = np.where(head, -1, 8 * width)
    for t in range(width):
        split = interval[1:] == interval[:-1]
        many = np.zeros(m, bool)
        many[1:] |= split
        many[:-1] |= split
        at = np.flatnonzero(many)
        if not len(at):
            break
        sym = symbols[order[at], t]
        if not ((sym[1:] != sym[:-1]) & (interval[at][1:] == interval[at][:-1])).any():
            continue
        by = np.lexsort((sym, interval[at]))
        order[at], sym = order[at][by], sym[by]
        cut = np.flatnonzero((sym[1:] != sym[:-1]) & (interval[at][1:] == interval[at][:-1]))
        differ = sym[cut] ^ sym[cut + 1]
        same = sum((differ < (np.uint64(1) << np.uint64(8 * k))).astype(np.int64) for k in range(1, 8))
        lcp[at[cut + 1]] = 8 * t + same
        new = np.zeros(m, np.int64)
        new[at[cut + 1]] = 1
        new[1:] += interval[1:] != interval[:-1]
        interval = np.cumsum(new > 0)
    return order, lcp


def repeated(contexts: list[bytes], group: np.ndarray, left: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Which windows occur twice: row i, column a is the window that starts a bytes left of the anchor of context i.

    left: bytes before the anchor in the context; first: the smallest a that its context covers; group: anchors, ascending.
    """
    m, reach = len(contexts), window - GRAM
    width = -(-window // 8) * 8
    x = np.zeros((m, reach + width), np.uint8)  # byte + 1; 0 where the context has none (UTF-8 has no byte 255)
    for i, c in enumerate(contexts):
        c = c[: left[i] + window]
        x[i, reach - left[i] : reach - left[i] + len(c)] = np.frombuffer(c, np.uint8) + 1
    order, lcp = interleave(np.ascontiguousarray(x[:, reach:]).view(">u8").astype(np.uint64), group)
    lcp = np.where(lcp < 0, -1, np.minimum(lcp, window))
    found = np.zeros((m, reach + 1), bool)
    same = lcp >= 0
    groups = group[order]
    for a in range(int(left.max()) + 1):
        hit = np.flatnonzero(lcp >= window)
        if len(hit):
            found[order[hit], a] = True
            found[order[hit - 1], a] = True
        if a == reach:
            break
        before = x[order, reach - 1 - a]
        cut = np.flatnonzero((before[1:] != before[:-1]) & same[1:])
        if not len(cut):
            lcp += same
            continue
        old = np.append(lcp, 0)
        lcp += same
        touched = np.isin(groups, np.unique(groups[cut]))
        at = np.flatnonzero(touched)
        by = at[np.lexsort((before[at], groups[at]))]  # old places in their new order
        joined = same[at][1:] & (before[by][1:] == before[by][:-1])
        pair = np.flatnonzero(joined)
        lcp[at] = np.where(same[at], 0, -1)
        if len(pair):
            spans = np.stack([by[pair] + 1, by[pair + 1] + 1], 1).ravel()
            lcp[at[pair + 1]] = 1 + np.minimum.reduceat(old, spans)[::2]
        order[at] = order[by]
    a = np.arange(reach + 1)
    return found & (a >= first[:, None]) & (a <= left[:, None])


def merged(contexts: DataFrame, window: int) -> DataFrame:
    """Byte ranges (row, start, end) of repeated windows in contexts (g, c, row, p0, p1, s, a0, a1, ctx) that are not repeated as a whole.

    g: the merge, an anchor or a part of one; a0, a1: how far to the left of the anchor its windows start, least and most.
    """
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ranges(held: list[tuple]) -> pa.RecordBatch:
        c, p0, p1, s, a0, a1 = (np.array([r[i] for r in held], np.int64) for i in (1, 3, 4, 5, 6, 7))
        group = np.cumsum([0, *(x[0] != y[0] for x, y in itertools.pairwise(held))])
        found = repeated([r[8] for r in held], group, s - p0, s - p1, window) & (c == 1)[:, None]
        at = np.arange(found.shape[1])
        found &= (at >= a0[:, None]) & (at <= a1[:, None])
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        return pa.RecordBatch.from_pydict({"row": pa.array([held[k][2] for k in i], pa.binary()), "start": pa.array(s[i] - hi + 1), "end": pa.array(s[i] - lo + window)})

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if len(held) >= CHUNK and r[0] != held[-1][0]:
                    yield ranges(held)
                    held = []
                held.append(r)
        if held:
            yield ranges(held)

    columns = contexts.select("g", "c", "row", "p0", "p1", "s", "a0", "a1", "ctx")
    return columns.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, "row binary, start long, end long")


def parted(contexts: DataFrame, window: int, hot: int, crowded: bool) -> tuple[DataFrame, DataFrame]:
    """Contexts (h, d, c, row, p0, p1, s, ctx) dealt to merges, with g, a0 and a1; and the ranges (row, start, end) of windows that the dealing alone shows to be equal. d: the contexts of the anchor; crowded: may some have more than `hot`."""
    reach = window - GRAM
    rows = contexts.withColumns({"g": F.expr("unhex(lpad(hex(h), 16, '0'))"), "a0": F.lit(0), "a1": F.lit(reach)})
    ranges = rows.sparkSession.createDataFrame([], "row binary, start long, end long")
    if not crowded:
        return rows.drop("d"), ranges
    out, rows = rows.where(F.col("d") <= hot).drop("d"), rows.where(F.col("d") > hot).drop("d")
    while True:
        halves = F.array(F.struct(F.col("a0"), F.expr("(a0 + a1) div 2").cast("int").alias("a1")), F.struct(F.expr("(a0 + a1) div 2 + 1").cast("int").alias("a0"), F.col("a1")))
        rows = rows.withColumn("half", F.explode(halves)).withColumns({"a0": F.col("half.a0"), "a1": F.col("half.a1")}).drop("half")
        # a window starts a bytes left of the anchor; all windows of a half hold the a0 bytes before it, the anchor, and what the leftmost window reaches behind
        shared = F.expr(f"substring(ctx, cast(s - p0 - a0 + 1 as int), cast({window} - (a1 - a0) as int))")
        rows = rows.where("s - p0 >= a0 and s - p1 <= a1")
        key = F.concat(F.col("g"), F.concat_ws(" ", F.col("a0").cast("string"), F.col("a1").cast("string"), F.lit("")).cast("binary"), shared)
        rows = written(rows.withColumn("g", F.unhex(F.md5(key))), "parts")
        sizes = rows.groupBy("g").agg(F.count("*").alias("d")).where("d > 1")
        sized = rows.join(sizes, "g")
        out = out.unionByName(sized.where(F.col("d") <= hot).drop("d"))
        sized = sized.where(F.col("d") > hot).drop("d")
        # one start left: its windows are equal
        same = sized.where("a0 = a1 and c = 1").select("row", (F.col("s") - F.col("a0")).alias("start"), (F.col("s") - F.col("a0") + window).alias("end"))
        ranges = ranges.unionByName(same)
        rows = written(sized.where("a0 < a1"), "parts")
        if rows.isEmpty():
            return out, ranges


def repeated_ranges(docs: DataFrame, window: int, hot: int = HOT) -> DataFrame:
    """(row, start, end): byte ranges of docs (row, text) whose union is covered by strings of `window` bytes that start at two places."""
    occ = written(samples(docs, window), "anchors")
    ctx = occ.groupBy("digest").agg(F.first("h").alias("h"), F.count("*").alias("c"), F.min(F.struct("row", "p0", "p1", "s")).alias("at"))
    anchors = ctx.groupBy("h").agg(F.count("*").alias("d"))
    ctx = written(ctx.join(anchors, "h").where("c > 1 or d > 1"), "contexts")
    whole = occ.join(ctx.where("c > 1").select("digest"), "digest").select("row", F.col("p0").alias("start"), (F.col("p1") + window).alias("end"))
    context = F.expr(f"substring(cast(text as binary), cast(p0 + 1 as int), cast(p1 - p0 + {window} as int))")
    texts = docs.join(ctx.where("d > 1").select("h", "c", "d", "at.*"), "row").select("h", "c", "d", "row", "p0", "p1", "s", context.alias("ctx"))
    merges, ranges = parted(texts, window, hot, not ctx.where(F.col("d") > hot).isEmpty())
    return whole.unionByName(merged(merges, window)).unionByName(ranges)


def joined_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (row, start, end) joined where they touch, so that no more of a row's ranges meet in a list than it has runs."""
    order = Window.partitionBy("row").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("opens", F.coalesce(before < F.col("start"), F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def drop_repeats(docs: DataFrame, window: int = 400, hot: int = HOT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A byte goes if a string of `window` bytes that covers it also starts anywhere else in the corpus, as read; of equal strings
    all go. Null text is empty; shorter texts lose nothing, longer ones are read whole. Rows that repeat a doc_id are different
    documents, equal rows are copies. Further columns are ignored, of whatever name; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.unhex(F.md5(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"))))  # equal rows are treated alike
    ranges = repeated_ranges(texts.select("row", "text"), window, hot)
    ranges = joined_ranges(ranges).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = binary(b.column(1))
            out = []
            for i, spans in enumerate(b.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                step = np.zeros(len(text) + 1, np.int32)
                for x in spans or ():
                    step[x["start"]] += 1
                    step[x["end"]] -= 1
                gone = np.cumsum(step[:-1]) > 0
                kept = text[~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3]), "kept": pa.array(cols[4], pa.binary())}
            )

    joined = texts.join(ranges, "row", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark, sf_dir):
    return drop_repeats(table(spark, "documents", sf_dir)).drop("kept")
