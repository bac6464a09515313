"""Periodic runs of words, from Lyndon arrays that the first phase of Baier's suffix sorter yields.

The phase groups suffixes by their Lyndon prefixes. Groups are taken from the largest down. Each suffix of the group is
removed and looks for the nearest suffix before it that is left, whose group is smaller: that one's Lyndon prefix goes on with
the group's. Suffixes that go on so equally often move, together with those of the same old group, to a new group directly
above it. When all groups are done, the length that a suffix has come to is that of the longest Lyndon word which starts there:
no suffix is ever compared with another.

Every run has a Lyndon root, under the order of words or under its reverse, which is the longest Lyndon word at each place
where it starts in the run. So roots that follow themselves twice are extended by longest common extensions to both sides,
and those that are long enough are the runs.

A run of four periods and six words repeats each of its sequences of three words twice at least. Words outside such sequences
are in no run, and the stretches between them are grouped each by itself.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, mix, slabs, small_batches, table, words

#: A run has so many words and so many periods at least. Three words recur in it so many times.
LEAST, PERIODS, RECUR = 6, 4, 3
#: Bytes of text that are looked at together.
SLAB = 1 << 20


def lyndon_lengths(s: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of s, by Baier's grouping."""
    n = len(s)
    left, right = [*range(-1, n), -1], [*range(1, n + 1), -1, 0]  # of those not yet removed; place n stands for the end, -1 for what is before
    length, group, members = [1] * n, [0] * n, []
    last = None
    for i in sorted(range(n), key=s.__getitem__):
        if s[i] != last:
            last = s[i]
            members.append([])
        members[-1].append(i)
        group[i] = len(members) - 1
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    g = len(members) - 1
    while g >= 0:
        own, before, times = [i for i in members[g] if group[i] == g], [], []
        last = -1
        for i in own:
            j, k = left[i], right[i]
            left[k], right[j] = j, k
            if j == last:
                if j >= 0:
                    times[-1] += 1
            else:
                last = j
                before.append(j)
                times.append(1)
        if before:
            size = length[own[0]]
            for t in sorted(set(times), reverse=True):
                moved: dict[int, int] = {}
                for j, x in zip(before, times, strict=True):
                    if x != t:
                        continue
                    old = group[j]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append([])
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        below[up], above[old] = new, new
                    group[j] = new
                    members[new].append(j)
                    length[j] += t * size
        g = below[g]
    return length


def extension(s: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words are equal from i and j (i < j) on, to the right (step 1) or to the left (-1)."""
    out, width, most = 0, 16, len(s) - j if step > 0 else i + 1
    while out < most:
        width = min(2 * width, most - out)
        a, b = (s[i + out : i + out + width], s[j + out : j + out + width]) if step > 0 else (s[i - out - width + 1 : i - out + 1][::-1], s[j - out - width + 1 : j - out + 1][::-1])
        differ = a != b
        if differ.any():
            return out + int(differ.argmax())
        out += width
    return out


def runs(s: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of s (codes of words) with LEAST words and PERIODS periods, by start and period."""
    found = set()
    for order in (s, -s):
        of = np.array(lyndon_lengths(order.tolist()), np.int64)
        at = np.flatnonzero(of <= len(s) // PERIODS)
        at = at[at + 3 * of[at] <= len(s)]
        p = of[at]
        ok = (of[at + p] == p) & (of[at + 2 * p] == p)
        reach: dict[int, int] = {}
        for i, p in zip(at[ok].tolist(), p[ok].tolist(), strict=True):
            if i + p <= reach.get(p, 0):
                continue  # the root lies in the run of this period that was found last
            end = i + p + extension(s, i, i + p, 1)
            reach[p] = end
            start = i - (extension(s, i - 1, i + p - 1, -1) if i else 0)
            if end - start >= max(LEAST, PERIODS * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def recurring(ids: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of words of one row that sequences of three words cover which occur RECUR times in the row. ids: codes of the words."""
    n = len(ids)
    if n < LEAST:
        return []
    key = mix(ids[:-2] * np.uint64(0x9E3779B97F4A7C15) + ids[1:-1])
    key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + ids[2:])
    key = mix(key ^ row[:-2] * np.uint64(0x165667B19E3779F9))
    own = np.flatnonzero(row[:-2] == row[2:])
    if not len(own):
        return []
    by = np.argsort(key[own], kind="stable")
    sort = key[own][by]
    heads = np.flatnonzero(np.concatenate(([True], sort[1:] != sort[:-1])))
    many = np.repeat(np.diff(np.append(heads, len(sort))) >= RECUR, np.diff(np.append(heads, len(sort))))
    step = np.zeros(n + 1, np.int32)
    at = own[by[many]]
    step[at] += 1
    np.add.at(step, at + 3, -1)
    inside = np.cumsum(step[:-1]) > 0
    edge = np.concatenate(([True], row[1:] != row[:-1], [True]))
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= LEAST]


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of its words a document of n words has at each place, if its id says that they repeat: a part from some place on. A null id says nothing."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def summary(found: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run of greatest exponent (start, length, period, exponent_milli), and the digest of all runs."""
    digest = hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest()
    if not found:
        return 0, None, None, None, None, digest
    a, n, p = min(found, key=cmp_to_key(lambda x, y: y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2]))
    return len(found), a, n, p, 1000 * n // p, digest


FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): its runs, the digest of them, the one of greatest exponent, and the text without repetitions.

    A run is a stretch of words with a smallest period, of six words and four periods at least, that cannot be made longer.
    `collapsed` has, of the words, those that no run contains behind its first period, joined by single spaces. With `rewrite`, the
    words of some documents, chosen by id, first repeat a part of themselves (see `rewritten`). A null or empty text has no words
    and no runs; a long one is taken whole, in one task. Rows are judged each by itself, so repeated ones and null ids matter to
    none but themselves. Further columns are ignored, of whatever name; an empty table gives an empty result. Equal exponents:
    smallest start, then smallest period.
    """

    def run(batches):
        for rows, data, offsets in slabs(batches, "text", SLAB, 2048):
            space = SPACE[data]
            starts, ends, first = words(data, offsets, ~space)
            bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
            letters = np.ascontiguousarray(data[~space])
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
            ids = coded.indices.to_numpy().astype(np.int64)
            doc = rows.column("doc_id").to_pylist()
            moved, place = {}, None  # of rewritten documents, the words by their old places
            for r, i in enumerate(doc):
                new = rewritten(i, int(first[r + 1] - first[r])) if rewrite else None
                if new is not None:
                    moved[r] = new
                    place = np.arange(len(ids)) if place is None else place
                    place[first[r] : first[r + 1]] = first[r] + new
            ids = ids if place is None else ids[place]
            row = np.repeat(np.arange(len(doc)), np.diff(first))
            found: list[list] = [[] for _ in doc]
            for a, b in recurring(ids.astype(np.uint64), row.astype(np.uint64)):
                r = row[a]
                found[r] += [(a - int(first[r]) + x, n, p) for x, n, p in runs(ids[a:b])]
            out = []
            for r, i in enumerate(doc):
                lo, hi = int(first[r]), int(first[r + 1])
                keep = np.ones(hi - lo, bool)
                for a, n, p in found[r]:
                    keep[a + p : a + n] = False
                out.append((i, *summary(found[r]), joined(data, starts[lo:hi], ends[lo:hi], moved.get(r), keep), found[r]))
            yield batch(out)

    def joined(data, starts, ends, moved, keep):
        if moved is not None:
            starts, ends = starts[moved], ends[moved]
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return b""
        size = ends - starts + 1
        ahead = np.cumsum(size) - size
        at = np.repeat(starts - ahead, size) + np.arange(int(size.sum()))
        at[-1] = starts[0]
        out = data[at]
        out[ahead + size - 1] = 32
        return out[:-1].tobytes()

    def batch(out):
        cols = list(zip(*out, strict=True))
        values = [pa.array(c, pa.int64()) for c in cols[:6]]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        listed = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in f] for f in cols[8]], kind)
        digests = pa.array([hashlib.sha256(t).hexdigest() for t in cols[7]])
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        return pa.RecordBatch.from_arrays([*values, pa.array(cols[6]), digests, listed, pa.array(cols[7], pa.binary())], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, FIELDS)


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, "documents", sf_dir), rewrite=True).drop("runs", "collapsed")
