"""Token ids in a binary format of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, a continuation bitmap
that says which ids go on, and a rank directory with the count of set bits before each 512 bits. Any token is read by one
byte per level and one rank step between levels; no block is decoded. A shard holds consecutive documents with their
starts. Shards are numbered inside a run, a range of doc_ids or a stretch of an input file, and runs are in order.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, shared_path, slabs, table, written

MAGIC, BLOCK = b"DAC1", 512
#: Ids after which a shard is closed; a document stays in one shard.
SHARD = 1 << 20
#: Distinct words whose ids a Python worker remembers; and bytes and rows of texts that are encoded at once.
REMEMBER, SLAB, SLAB_ROWS = 160_000, 2 << 20, 4096
#: Signs that end words, small letters and digits behind which they are always pieces of their own, and white space.
IS_SIGN, PLAIN, WHITE = np.zeros(256, bool), np.zeros(256, bool), bytes(np.flatnonzero(SPACE).tolist())
IS_SIGN[list(b".,;:!?%#*$&")] = PLAIN[48:58] = PLAIN[97:123] = True
#: Fixed value: the pattern of a tokenizer that cuts texts into pieces of letters, single digits and runs of signs.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id

_ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint32)


def encode(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard: header, doc_ids, starts, then the levels."""
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % 4, np.uint8)))
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(_ones[bits], np.arange(0, len(bits), BLOCK // 8))))) if len(bits) else np.zeros(1)
        levels.append(struct.pack("<QQ", len(rest), len(bits)) + ranks.astype("<u4").tobytes() + bits.tobytes() + (rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    return MAGIC + struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)) + doc_ids.astype("<i8").tobytes() + starts.tobytes() + b"".join(levels)


class Shard:
    """Reads a shard in place."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        depth, docs, self.n = struct.unpack_from("<IQQ", blob, 4)
        at = 24
        self.doc_ids = np.frombuffer(blob, "<i8", docs, at)
        self.starts = np.frombuffer(blob, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.levels = []
        for _ in range(depth):
            n, nbits = struct.unpack_from("<QQ", blob, at)
            blocks = -(-nbits * 8 // BLOCK) + 1
            ranks = np.frombuffer(blob, "<u4", blocks, at + 16)
            bits = np.frombuffer(blob, np.uint8, nbits, at + 16 + 4 * blocks)
            chunks = np.frombuffer(blob, np.uint8, n, at + 16 + 4 * blocks + nbits)
            self.levels.append((ranks, bits, chunks))
            at += 16 + 4 * blocks + nbits + n

    def rank(self, level: int, i: int) -> int:
        """Set continuation bits before i."""
        ranks, bits, _ = self.levels[level]
        block = i // BLOCK
        tail = bits[block * BLOCK // 8 : i // 8]
        part = int(bits[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(ranks[block]) + int(_ones[tail].sum()) + part.bit_count()

    def token(self, i: int) -> int:
        """The i-th id of the shard."""
        out = 0
        for level, (_, bits, chunks) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                return out
            i = self.rank(level, i)
        raise ValueError("the last level goes on")

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1, without reading others."""
        out, where, lo, hi = np.zeros(b - a, np.uint32), np.arange(b - a), a, b
        for level, (_, bits, chunks) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            where = where[more]
            if not len(where):
                break
            lo, hi = self.rank(level, lo), self.rank(level, lo) + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


@lru_cache(2)
def tokenizer(path: str):
    """The tokenizer, its words' ids as far as they are remembered, the type of the ids, and which ids end a word (None: the tokenizer may join across white space)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    size = t.get_vocab_size()
    ends = None
    if by_word(path):
        ends = np.zeros(size, bool)
        ends[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
    return t, Memory(), np.uint16 if size <= 1 << 16 else np.uint32, ends


def by_word(path: str) -> bool:
    """Does the tokenizer fold case, cut texts by WORDS alone and so drop white space? Then words between ASCII white space can be encoded one by one."""
    with open(path, encoding="utf-8") as file:
        d = json.load(file)
    steps = lambda x, many: (x or {}).get(many) or ([x] if x else [])
    cuts = [x for x in steps(d.get("pre_tokenizer"), "pretokenizers") if x["type"] == "Split"]
    folds = [x["type"] for x in steps(d.get("normalizer"), "normalizers")]
    spaces = all(re.search(r"\s", x["content"]) is None for x in d.get("added_tokens") or ())
    model = d["model"]
    return (
        spaces and "Lowercase" in folds and set(folds) <= {"NFC", "Replace", "Lowercase"} and [(x["pattern"], x["behavior"], x["invert"]) for x in cuts] == [({"Regex": WORDS}, "Removed", True)]
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
    )


class Memory:
    """Ids (as bytes) of the words used last: of two halves, the older is forgotten when the younger is full."""

    def __init__(self, size: int = REMEMBER):
        self.half, self.young, self.old = size // 2, {}, {}

    def get(self, words: list[bytes]) -> list[bytes | None]:
        found = list(map(self.young.get, words))
        for i, ids in enumerate(found):
            if ids is None and (ids := self.old.get(words[i])) is not None:
                self.put(words[i], ids)
                found[i] = ids
        return found

    def put(self, word: bytes, ids: bytes) -> None:
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[word] = ids


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with A-Z mostly in lower case, and the bounds of pieces that are encoded apart: words with the white space behind them, cut before the
    signs they end with. A word is cut only behind an ASCII letter or digit: before a sign these are never changed by
    normalisation. Where added tokens may occur, which are matched before case is folded, words stay as they are."""
    edge = np.zeros(len(data) + 1, bool)
    space = SPACE[data]
    edge[1:] = space
    edge[offsets] = True
    if b"<|" in data.tobytes():
        return data, np.flatnonzero(edge)
    low = LOWER[data]
    marked = np.flatnonzero(data[1:] >= 128)  # a capital keeps its case before a mark that may be joined to it
    low[marked] = data[marked]
    starts = np.flatnonzero(edge[:-1])
    if len(starts):
        inner = np.where(space | IS_SIGN[low], np.int32(-1), np.arange(len(low), dtype=np.int32))
        last = np.maximum.reduceat(inner, starts)
        last = last[last >= 0]
        last = last[PLAIN[low[last]] & (last + 1 < len(low))]
        edge[last[IS_SIGN[low[last + 1]]] + 1] = True
    return low, np.flatnonzero(edge)


def learn(words: list[bytes], t, kind, ends: np.ndarray) -> list[bytes]:
    """Ids of each word. Words of letters are encoded joined by spaces: each is one piece, whose last id, and no other, ends a word."""
    out: dict[bytes, bytes] = {}
    batch = getattr(t, "encode_batch_fast", t.encode_batch)
    text = {w: w.decode("utf-8", "replace") for w in words}
    letters = [w for w in words if text[w].isalpha()]
    groups = [letters[i : i + 1000] for i in range(0, len(letters), 1000)]
    for group, e in zip(groups, batch([" ".join([text[w] for w in g]) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, kind)
        last = np.flatnonzero(ends[ids]) + 1
        if len(last) == len(group):  # otherwise a word has two pieces, as a letter whose lower case has a mark
            raw, step = ids.tobytes(), ids.itemsize
            at = [0, *(last * step).tolist()]
            out.update(zip(group, (raw[a:b] for a, b in zip(at, at[1:])), strict=True))
    rest = [w for w in words if w not in out]
    for w, e in zip(rest, batch([text[w] for w in rest], add_special_tokens=False), strict=True):
        out[w] = np.array(e.ids, kind).tobytes()
    return [out[w] for w in words]


def ids_of(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (UTF-8, row i is data[offsets[i]:offsets[i + 1]]) without special tokens, one behind the other, and the number of ids of each text.

    If the tokenizer never joins across white space, the distinct words of all texts are looked up or encoded once; else texts
    are encoded whole.
    """
    t, memory, kind, ends = tokenizer(path)
    if ends is None:
        batch = getattr(t, "encode_batch_fast", t.encode_batch)
        got = [np.array(e.ids, np.uint32) for e in batch([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])], add_special_tokens=False)]
        return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
    data, bounds = pieces(data, offsets)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    names = [w.rstrip(WHITE) for w in coded.dictionary.to_pylist()]
    found = memory.get(names)
    new = {names[i] for i, ids in enumerate(found) if ids is None}
    if new:
        new = dict(zip(new, learn(list(new), t, kind, ends), strict=True))
        for w, ids in new.items():
            memory.put(w, ids)
        found = [new[w] if ids is None else ids for w, ids in zip(names, found, strict=True)]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(kind).itemsize
    flat, begins = np.frombuffer(b"".join(found), kind), np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy()
    n = sizes[which]
    ahead = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(begins[which] - ahead[:-1], n) + np.arange(ahead[-1])].astype(np.uint32)
    return ids, np.diff(ahead[np.searchsorted(bounds, offsets)])


SHARDS = "file string, run long, seq long, before long, n_ids long, blob binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard: int = SHARD, given: bool = False) -> str:
    """Writes docs (doc_id, text) as shards to a new table in the shared folder; returns its path.

    Documents are in ascending doc_id order; rows that repeat a doc_id are ordered by text, and a null doc_id comes first. With
    `given`, docs must be rows of files, and they keep the order of the files' part numbers and names and of the rows in
    them: nothing is sorted or moved. Each text is encoded whole, however long, and end_id follows. Null and empty texts are
    end_id alone. Further columns are ignored, of whatever name; an empty table gives an empty set of shards. The texts are
    range partitioned, not the ids: encoding, which makes the data larger, happens behind the shuffle.
    """
    spark = docs.sparkSession
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if given:
        rows = docs.select(*own, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = docs.select(*own).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
        rows = rows.select("doc_id", "text", F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("row"))

    def run(batches):
        place, seq, before, after = None, 0, 0, None
        names, lengths, held, total = [], [], [], 0

        def close():
            blob = encode(np.concatenate(names), np.concatenate(lengths), np.concatenate(held))
            return pa.RecordBatch.from_pydict({"file": pa.array([place[0]]), "run": pa.array([place[1]], pa.int64()), "seq": pa.array([seq], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([total], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for b, data, offsets in slabs(batches, "text", SLAB, SLAB_ROWS):
            # a slab is one run unless its file changes or its rows do not follow
            files, at = b.column(2).to_pylist(), b.column(3).to_numpy()
            breaks = [i for i in range(b.num_rows) if (i or place) and (files[i] != (files[i - 1] if i else place[0]) or (given and at[i] != (at[i - 1] if i else after) + 1))]
            after = at[-1]
            ids, n = ids_of(data, offsets, tokenizer_path)
            where = np.concatenate(([0], np.cumsum(n)))
            ids, n = np.insert(ids, where[1:], np.uint32(end_id)), n + 1
            where += np.arange(len(where))
            doc = b.column(0).fill_null(NO_ID).to_numpy()
            for lo, hi in itertools.pairwise(sorted({0, *breaks, b.num_rows})):
                if lo in breaks or place is None:
                    if held:
                        yield close()
                    place, seq, before = (files[lo], int(at[lo])), 0, 0
                    names, lengths, held, total = [], [], [], 0
                for i, j in cuts_at(n[lo:hi], total, shard):
                    names.append(doc[lo + i : lo + j])
                    lengths.append(n[lo + i : lo + j])
                    held.append(ids[where[lo + i] : where[lo + j]])
                    total += len(held[-1])
                    if total >= shard:
                        yield close()
                        seq, before = seq + 1, before + total
                        names, lengths, held, total = [], [], [], 0
        if held:
            yield close()

    path = shared_path(spark, "tokens")
    rows.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)
    return path


def cuts_at(n: np.ndarray, total: int, shard: int):
    """Runs (i, j) of documents with n ids each: each but the last ends with the document that fills a shard which holds `total` ids already."""
    ends, i = np.cumsum(n), 0
    while i < len(n):
        done = int(ends[i - 1]) if i else 0
        j = min(len(n), int(np.searchsorted(ends, done + shard - total)) + 1)
        yield i, j
        i, total = j, 0


def in_files(docs: DataFrame) -> bool:
    """Are these the rows of files, whose order can be told?"""
    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the shards at path: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array). All are read from the shards.

    Rows that repeat a doc_id are separate documents, each with its start; a document written from null or empty text has its
    end id only. No shards give no rows. Documents may have up to 2**31 - 1 ids.
    """

    def run(batches):
        for b in batches:
            for base, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Shard(blob)
                for lo in range(0, len(s.doc_ids), 500):
                    hi = min(lo + 500, len(s.doc_ids))
                    begins = s.starts[lo : hi + 1] - s.starts[lo]
                    flat = s.slice(int(s.starts[lo]), int(s.starts[hi]))
                    raw = memoryview(flat.astype("<u4").view(np.uint8))
                    out = {
                        "doc_id": pa.array([None if x == NO_ID else x for x in s.doc_ids[lo:hi].tolist()], pa.int64()),
                        "start": pa.array(base + s.starts[lo:hi]),
                        "n_tokens": pa.array(np.diff(begins)),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in itertools.pairwise(begins.tolist())], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat.view(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    shards = spark.read.schema(SHARDS).parquet(path)
    # one row for each run, which is a range partition or a split of a file; then one for each file
    runs = shards.groupBy("file", "run").agg(F.sum("n_ids").alias("n"))
    earlier = "rows between unbounded preceding and 1 preceding"
    files = runs.groupBy("file").agg(F.sum("n").alias("n")).withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long"))
    files = files.selectExpr("file", f"coalesce(sum(n) over (order by part, file {earlier}), 0) as base")
    runs = runs.join(files, "file").selectExpr("file", "run", f"base + coalesce(sum(n) over (partition by file order by run {earlier}), 0) as base")
    runs = written(runs, "runs")  # so that its size is known when Spark chooses how to join
    based = shards.join(runs, ["file", "run"]).select((F.col("base") + F.col("before")).alias("base"), "blob")
    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_output(spark, sf_dir):
    return read_tokens(spark, write_tokens(table(spark, "documents", sf_dir), vocabulary()), with_ids=False)
