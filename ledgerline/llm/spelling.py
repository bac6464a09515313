"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

A tile is a padded matrix of Latin-1 code points, one word a column. Two tiles are compared as a whole, position by position
from both ends, which gives the common prefix and suffix of every pair of their words. Words are one inserted, deleted or
replaced code point apart if, and only if, these two together reach the longer length less one.

Which words share a tile follows from the same rule: one of the two ends must then hold half of the longer length. So a word
of l letters joins, for the longer lengths l and l + 1, the group of its first half and the group of its last half. A group
too large for a task is halved again in the same way, in the stretch that its words do not share yet, until one code point is
left, where a group has as many words as the alphabet has letters. A pair belongs to one half only, by its common prefix, so
that no pair is found twice and none is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, shared_path, slabs, small_batches, table, words, written

#: Words of fewer code points or occurrences are left out; one run in so many is misspelt on purpose; a form occurs so many times more often.
SHORTEST, RAREST, MISSPELT, OFTENER = 5, 3, 97, 2
#: Words and code points that a group is compared with as it is; columns of a tile.
GROUP, LETTERS, TILE = 4096, 1 << 23, 512
#: Bytes of text that are counted at once.
SLAB = 2 << 20
GROUP_ID = ["size", "head", "tail", "most", "part"]

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
#: Lengths up to which checksums are continued by table.
_LONG = 48


def _zero_bytes(longest: int) -> np.ndarray:
    """What a CRC-32 register becomes by n zero bytes, as tables [n, byte of the register, its value]."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


_shift = _zero_bytes(_LONG)


def checksums(before: np.ndarray, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from those of a and of b, and the length of b in bytes (_LONG at most)."""
    out = own.copy()
    for k in range(4):
        out ^= _shift[lengths, k, (before >> np.uint32(8 * k)) & 255]
    return out


def runs_of_letters(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The runs of A-Z, a-z and U+00C0 to U+00FF of each row in lower case (A-Z only), as codes of distinct ones, and the row of each."""
    low = LOWER[data]
    lead = low == 0xC3  # the first byte of U+00C0 to U+00FF, and of nothing else
    inside = _letter[low] | lead
    inside[1:] |= lead[:-1]
    starts, ends, first = words(low, offsets, inside)
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    values = np.ascontiguousarray(low[inside])
    runs = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(values)])
    return runs.dictionary_encode(), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n, l (code points) of docs (doc_id, text). A null doc_id is written as nothing in the checksum."""

    def run(batches):
        for rows, data, offsets in slabs(batches, "text", SLAB, 4096):
            coded, row = runs_of_letters(data, offsets)
            if not len(row):
                continue
            names = coded.dictionary.to_pylist()
            code = coded.indices.to_numpy()
            size = np.fromiter(map(len, names), np.int64, len(names))
            ids = rows.column("doc_id").to_pylist()
            before = np.array([zlib.crc32(b"%d:" % i if i is not None else b":") for i in ids], np.uint32)
            own = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
            h = checksums(before[row], own[code], np.minimum(size, _LONG)[code])
            for at in np.flatnonzero((size > _LONG)[code]):
                h[at] = zlib.crc32(names[code[at]], int(before[row[at]]))
            changed = np.flatnonzero(h % MISSPELT == 0)
            n = np.bincount(code, minlength=len(names)) - np.bincount(code[changed], minlength=len(names))
            letters = {i: names[i].decode() for i in np.unique(code[changed]).tolist()}
            other: Counter[str] = Counter()
            for i, x in zip(code[changed].tolist(), h[changed].tolist(), strict=True):
                word = letters[i]
                at = x % len(word)
                other[word[:at] + word[at + 1 :]] += 1
            whole = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_pydict({
                "word": pa.concat_arrays([coded.dictionary.take(whole).cast(pa.string()), pa.array(list(other), pa.string())]),
                "n": pa.array(np.concatenate((n[n > 0], np.fromiter(other.values(), np.int64, len(other))))),
            })

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    counted = rows.mapInArrow(run, "word string, n long").withColumn("l", F.char_length("word").cast("int")).where(F.col("l") >= SHORTEST)
    return counted.groupBy("word", "l").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST).select("word", "n", "l")


def groups(words: DataFrame) -> DataFrame:
    """Each word (word, n, l) in the groups of its halves. A group has `size`, the longer length of its pairs, whose words share the first `head` and
    the last `tail` code points, together `part`; its pairs are those with a common prefix below `most`."""
    lengths = F.explode(F.array("l", F.expr("l + 1"))).alias("size")
    ends = F.explode(F.expr("array(struct(size div 2 as head, 0 as tail, size + 1 as most), struct(0 as head, size - size div 2 as tail, size div 2 as most))")).alias("end")
    return named(words.select("word", "n", "l", lengths).select("*", ends))


def named(rows: DataFrame) -> DataFrame:
    rows = rows.selectExpr("word", "n", "l", "size", "cast(end.head as int) as head", "cast(end.tail as int) as tail", "cast(end.most as int) as most")
    return rows.withColumn("part", F.expr("concat(left(word, head), right(word, tail))"))


def halved(rows: DataFrame) -> DataFrame:
    """The words of groups in their halves: the pairs whose prefix goes on for half of what is open, and the others, whose suffix then must."""
    half = "(size - head - tail) div 2"
    ends = f"array(struct(head + {half} as head, tail as tail, most as most), struct(head as head, size - head - {half} as tail, least(most, head + {half}) as most))"
    return named(rows.select("word", "n", "l", "size", F.explode(F.expr(ends)).alias("end")).where("end.head < end.most"))


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one word a column, padded with 0: from the first on, and from the last on."""
    width = max(map(len, words))
    ahead = np.array([w.ljust(width, b"\0") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)
    behind = np.array([w[::-1].ljust(width, b"\0") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)
    return np.ascontiguousarray(ahead.T), np.ascontiguousarray(behind.T)


def common(a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """Common prefixes of all columns of a with all of b, which share the first code points."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    out = np.full(alive.shape, shared, np.int32)
    for x, y in zip(a[shared:], b[shared:], strict=True):
        alive &= x[:, None] == y
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: list[bytes], size: int, head: int, tail: int, most: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes i < j of the words of a group that are one edit apart: tile against tile."""
    ahead, behind = matrix(words)
    whole = np.fromiter(map(len, words), np.int64, len(words)) == size
    found = []
    for x in range(0, len(words), tile):
        for y in range(x, len(words), tile):
            prefix = common(ahead[:, x : x + tile], ahead[:, y : y + tile], head)
            near = prefix < most
            near &= whole[x : x + tile, None] | whole[y : y + tile]
            near &= prefix + common(behind[:, x : x + tile], behind[:, y : y + tile], tail) >= size - 1
            i, j = np.nonzero(near)
            found.append((i + x, j + y) if y > x else (i[i < j] + x, j[i < j] + y))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def compared(tiles: DataFrame) -> DataFrame:
    """Of each word with a near word in its group: word, n_near and the best near word (best_n, best)."""
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def best(group: tuple, held: list[tuple]) -> tuple | None:
        held.sort()
        text = [w for w, _ in held]
        i, j = near_pairs([w.encode("latin-1") for w in text], *group[:4])
        if not len(i):
            return None
        i, j = np.concatenate((i, j)), np.concatenate((j, i))
        n = np.array([x for _, x in held])
        by = np.lexsort((j, -n[j], i))
        i, j = i[by], j[by]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        return [text[k] for k in i[first]], np.diff(np.append(first, len(i))).tolist(), n[j[first]].tolist(), [text[k] for k in j[first]]

    def run(batches):
        group, held, out = None, [], ([], [], [], [])

        def batch():
            return pa.RecordBatch.from_pydict({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()), "best_n": pa.array(out[2], pa.int64()), "best": pa.array(out[3], pa.string())})

        for b in batches:
            for *key, word, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if key != group:
                    if len(held) > 1 and (new := best(group, held)):
                        for have, more in zip(out, new, strict=True):
                            have.extend(more)
                        if len(out[0]) > 10_000:
                            yield batch()
                            out = ([], [], [], [])
                    group, held = key, []
                held.append((word, n))
        if len(held) > 1 and (new := best(group, held)):
            for have, more in zip(out, new, strict=True):
                have.extend(more)
        if out[0]:
            yield batch()

    rows = tiles.select(*GROUP_ID, "word", "n").repartition(parts, *GROUP_ID).sortWithinPartitions(*GROUP_ID)
    return rows.mapInArrow(run, "word string, n_near long, best_n long, best string")


def neighbours(words: DataFrame, group: int = GROUP, letters: int = LETTERS) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n, l) that have a near one."""
    rows, tiles = written(groups(words), "halves"), None
    while True:
        sizes = rows.groupBy(*GROUP_ID).agg(F.count("*").alias("d"), F.max("l").alias("longest"), F.sum("l").alias("letters")).where("d > 1 and longest = size")
        sized = rows.join(sizes, GROUP_ID)
        fits = ((F.col("d") <= group) & (F.col("letters") <= letters)) | F.expr("size - head - tail < 2")
        tiles = sized.where(fits) if tiles is None else tiles.unionByName(sized.where(fits))
        rows = written(halved(sized.where(~fits)), "halves")
        if rows.isEmpty():
            break
    found = compared(tiles)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form), by pointer doubling. A chain's counts double at each step, so it has no cycle and few steps."""
    spark = forms.sparkSession
    chain = written(forms.selectExpr("word", "form as root"), "roots")
    while True:
        onward = chain.selectExpr("word as root", "root as end")
        path = shared_path(spark, "roots")
        chain.join(onward, "root", "left").selectExpr("word", "coalesce(end, root) as root", "end is not null as moved").write.parquet(path)
        chain = spark.read.parquet(path)
        if chain.where("moved").isEmpty():
            return chain.select("word", "root")


def variants(docs: DataFrame, group: int = GROUP, letters: int = LETTERS) -> DataFrame:
    """One row per word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    form is the near word of largest n, the smallest in code-point order among equals, if it occurs at least twice as often as
    the word; root is where the forms lead, the word itself without one. Null and empty texts have no words; texts and words are
    taken whole, however long. Rows that repeat a doc_id, and equal rows, count each; a null doc_id is written as nothing in the
    checksum. Further columns are ignored, of whatever name; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    words = written(count_words(docs), "words")
    near = words.join(neighbours(words, group, letters), "word", "left")
    formed = F.col("best_n") >= OFTENER * F.col("n")
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "near")
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir):
    return variants(table(spark, "documents", sf_dir))
