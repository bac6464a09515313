"""Token counts; huge documents by encoding overlapping chunks that are spliced where they are proven to agree.

A byte-level tokenizer first cuts a text into pieces, from left to right, by a pattern that never looks back, and encodes
each by itself. So the ids behind a place where a piece starts depend on the text behind it alone. A chunk that begins anywhere
cuts wrongly at first, until one of its pieces starts where a piece of the whole text does; from there on it is right. And it is
right to its end, but for the last few letters, where the pattern would look ahead.

A huge document is cut into overlapping chunks that are encoded with offsets, each in any task. A chunk reports the places in its
overlaps where its pieces start, with the tokens before them. The first chunk starts right. Where a chunk that is right and the
next one share such a place, far enough from the end, the next one is right from there: the two are spliced. Where they
share none, as in a long stretch without a break, the document's chunks are joined by eights, which makes overlaps eight times
as wide, and encoded again, until all seams hold or one chunk is left.

Documents that fit a chunk are not cut. They are counted by pieces between white space that are remembered, where the
tokenizer's file shows that these are encoded by themselves, else whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, small_batches, table, text_column, written
from .tokens import Memory, vocabulary

#: Documents of more bytes are cut into chunks of so many code points, with so many more of the next; a wider cut joins so many chunks.
HUGE, STEP, OVERLAP, WIDER = 1 << 15, 1 << 14, 1 << 8, 8
#: Code points at the end of a chunk, besides the longest added token, that the pattern may judge otherwise than in the whole text.
AHEAD = 8
LIMIT = 512
#: Bytes and rows of texts that are counted at once; pieces up to so many bytes are remembered.
SLAB, SLAB_ROWS, PIECE = 2 << 20, 4096, 64

#: First bytes of the UTF-8 sequences of two, three and four bytes that are never white space.
_no_space = {2: [*range(0xC3, 0xE0)], 3: [0xE0, *range(0xE4, 0xF0)], 4: [*range(0xF0, 0xF5)]}
_graphic = np.zeros(256, bool)
_graphic[0x21:0x7F] = True


class Encoder:
    """A tokenizer file of one of the two libraries. `resumes`: do ids behind the start of a piece depend on what is behind alone?"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.margin, self.resumes, self.memory = AHEAD, False, Memory()
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as file:
            d = json.load(file)
        added = [x for x in d.get("added_tokens") or () if x["content"]]
        cut = d.get("pre_tokenizer") or {}
        self.margin += max([0, *(len(x["content"]) for x in added)])
        # one added token at most, without white space and not overlapping itself, is found at the same places from wherever one looks
        alone = len(added) <= 1 and all(not any(x["content"].startswith(x["content"][i:]) for i in range(1, len(x["content"]))) for x in added)
        plain = all(x["content"].split() == [x["content"]] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
        self.resumes = alone and plain and not d.get("normalizer") and not d["model"].get("dropout") and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not d.get("post_processor")

    def count(self, texts: list[str]) -> list[int]:
        if not hasattr(self.model, "encode_batch"):
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        batch = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        return [len(e) for e in batch(texts, add_special_tokens=False)]

    def chunk(self, text: str, overlap: int, last: bool) -> tuple[int, list, list]:
        """Tokens of a chunk, and the places where pieces start, each with the tokens before it: in its first `overlap` code points and, unless it is the last, in its last ones."""
        e = self.model.encode(text, add_special_tokens=False)
        n, head, tail = len(e), [], []

        def starts(i):
            return not i or e.token_to_word(i) != e.token_to_word(i - 1)

        for i in range(n):
            at = e.token_to_chars(i)[0]
            if at > overlap:
                break
            if starts(i):
                head.append((at, i))
        for i in range(n - 1, -1, -1) if not last else ():
            at = e.token_to_chars(i)[0]
            if at < len(text) - overlap:
                break
            if at <= len(text) - self.margin and starts(i):
                tail.append((at, i))
        return n, head, tail


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of stretches of the texts that start with ASCII white space behind a letter or sign: a piece surely starts there."""
    solid = _graphic[data]
    for size, firsts in _no_space.items():
        first = np.isin(data, firsts)
        solid[size - 1 :] |= first[: len(data) - size + 1]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = SPACE[data[1:]] & solid[:-1]
    edge[offsets] = True
    return np.flatnonzero(edge)


def counts(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text (UTF-8, row i is data[offsets[i]:offsets[i + 1]])."""
    e = encoder(path)
    if not e.resumes:
        return np.array(e.count([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]), np.int64)
    bounds = breaks(data, offsets)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    names = coded.dictionary.to_pylist()
    n = e.memory.get(names)
    new = [i for i, x in enumerate(n) if x is None]
    for i, x in zip(new, e.count([names[i].decode() for i in new]), strict=True):
        n[i] = x
        if len(names[i]) <= PIECE:
            e.memory.put(names[i], x)
    ahead = np.concatenate(([0], np.cumsum(np.array(n, np.int64)[coded.indices.to_numpy()]))) if n else np.zeros(1, np.int64)
    return np.diff(ahead[np.searchsorted(bounds, offsets)])


CHUNKS = "row long, doc_id long, n_bytes long, k long, last boolean, at long, text string"
MARKS = "array<struct<at:long,n:long>>"


def cut(docs: DataFrame, step: int, overlap: int) -> DataFrame:
    """Overlapping chunks of docs (row, doc_id, n_bytes, text): k, is it the last, where it starts (code points), its text."""

    def run(batches):
        for b in batches:
            for row, doc, size, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                n = max(1, -(-(len(text) - overlap) // step))
                for k in range(n):
                    part = text[k * step : (k + 1) * step + overlap] if k < n - 1 else text[k * step :]
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([size], pa.int64()), pa.array([k]), pa.array([k == n - 1]), pa.array([k * step]), pa.array([part])], names=["row", "doc_id", "n_bytes", "k", "last", "at", "text"])

    return docs.select("row", "doc_id", "n_bytes", "text").mapInArrow(run, CHUNKS)


def spliced(chunks: DataFrame, overlap: int, path: str) -> DataFrame:
    """row, doc_id, n_bytes, n_tokens of the chunks' documents; n_tokens is null where a seam has no common place."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        e = encoder(path)
        for b in batches:
            for row, doc, size, k, last, at, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                n, head, tail = e.chunk(text, overlap, last)
                head, tail = ([{"at": at + x, "n": i} for x, i in places] for places in (head, tail))
                kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([size], pa.int64()), pa.array([k]), pa.array([n], pa.int64()), pa.array([head], kind), pa.array([tail], kind)], names=["row", "doc_id", "n_bytes", "k", "n", "head", "tail"])

    marks = chunks.repartition(parts, "row", "k").mapInArrow(run, f"row long, doc_id long, n_bytes long, k long, n long, head {MARKS}, tail {MARKS}")
    seams = marks.withColumn("before", F.lag("tail").over(Window.partitionBy("row").orderBy("k")))
    seams = seams.withColumn("place", F.expr("array_min(array_intersect(before.at, head.at))"))
    seams = seams.withColumn("gain", F.expr("get(filter(before, x -> x.at = place), 0).n - get(filter(head, x -> x.at = place), 0).n"))
    whole = F.expr("max_by(n, k) + coalesce(sum(gain), 0)")
    return seams.groupBy("row", "doc_id", "n_bytes").agg(F.when(F.expr("count_if(k > 0 and gain is null) = 0"), whole).alias("n_tokens"))


def widened(chunks: DataFrame, step: int, overlap: int) -> DataFrame:
    """Chunks, which are `step` apart, joined by WIDER, each with `overlap` code points of the next. A last chunk that is no longer than that goes to the one before."""
    rows = chunks.withColumn("g", F.expr(f"(k - if(last and k > 0 and char_length(text) <= {overlap}, 1, 0)) div {WIDER}"))
    own = F.expr("struct(g, k, last, at, if(last, text, left(text, {0})) as text)".format(step))
    # what the joined chunk before has too, if this one opens the next
    ahead = F.when(F.expr(f"k > 0 and k % {WIDER} = 0 and g = k div {WIDER}"), F.expr(f"struct(g - 1 as g, k, false as last, at, left(text, {overlap}) as text)"))
    parts = rows.select("row", "doc_id", "n_bytes", F.explode(F.array_compact(F.array(own, ahead))).alias("x")).select("row", "doc_id", "n_bytes", "x.*")
    text = F.expr("concat_ws('', array_sort(collect_list(struct(k, text))).text)")
    joined = parts.groupBy("row", "doc_id", "n_bytes", "g").agg(F.bool_or("last").alias("last"), F.min("at").alias("at"), text.alias("text"))
    return joined.select("row", "doc_id", "n_bytes", F.col("g").alias("k"), "last", "at", "text")


def count_tokens(docs: DataFrame, path: str, huge: int = HUGE, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, as the tokenizer at `path` gives them for the whole text.

    No begin, end or other special tokens are added; special strings inside texts count as the library takes them. A null or
    empty text has 0. A text of more than `huge` bytes is spread over tasks in chunks; a stretch in it without any place to cut is
    encoded in one piece, at about 100 bytes of memory per token. Tokenizers that join pieces, or whose pieces depend on what is before
    them, encode texts of any length whole. Rows that repeat a doc_id, equal rows and null ids are documents of their own.
    Further columns are ignored, of whatever name; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = pa.struct([("n_tokens", pa.int64())])
    small = text_column(lambda texts, data, offsets: [pa.array(counts(data, offsets, path))], "struct<n_tokens:long>", kind, SLAB, SLAB_ROWS)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    if not encoder(path).resumes:
        return rows.select("doc_id", "n_bytes", small("text")["n_tokens"].alias("n_tokens"))
    out = rows.where(F.col("n_bytes") <= huge).select("doc_id", "n_bytes", small("text")["n_tokens"].alias("n_tokens"))
    chunks = written(cut(rows.where(F.col("n_bytes") > huge).withColumn("row", F.monotonically_increasing_id()), step, overlap), "chunks")
    while True:
        done = written(spliced(chunks, overlap, path), "spliced")
        out = out.unionByName(done.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        open_ = done.where("n_tokens is null").select("row")
        if open_.isEmpty():
            return out
        overlap *= WIDER
        chunks = written(widened(chunks.join(open_, "row", "left_semi"), step, overlap), "chunks")
        step *= WIDER


def op11_token_counts(spark, sf_dir):
    counted = count_tokens(table(spark, "documents", sf_dir), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
