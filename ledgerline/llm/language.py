"""Language identification with error-correcting output codes.

Each language has a codeword. One binary linear classifier for each bit of the code, over hashed byte n-grams, predicts that
bit of a text's codeword; the language whose codeword costs least under the classifiers' logistic losses, each weighted by
how reliable its bit was in training, is the answer. A small lead over the second language flags the text as ambiguous.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, slabs, table, text_column

#: Features, and orders of the byte n-grams that are hashed into them.
FEATURES, ORDERS = 4096, (1, 2, 3)
#: Labelled texts the model is fitted on, for each language: those of the smallest hash of doc_id.
SAMPLE = 600
#: Such texts in all, unless there are more languages.
ROWS = 20_000
STEPS, RATE, PENALTY = 80, 4.0, 1e-4
#: Score below which a prediction is flagged as ambiguous.
AMBIGUOUS = 0.55

LETTER = re.compile(r"[^\W\d_]")
_ascii_letters = np.zeros(256, bool)
_ascii_letters[97:123] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram counts of each row, at length 1."""
    rows = len(offsets) - 1
    low = LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.uint32) * np.uint32(FEATURES), np.diff(offsets))
    out = np.zeros(rows * FEATURES, np.float32)
    last = np.repeat(offsets[1:].astype(np.uint32), np.diff(offsets))
    for n in ORDERS:
        if len(low) < n:
            continue
        code = low[: len(low) - n + 1].copy()
        for i in range(1, n):
            code = code * np.uint32(257) + low[i : len(low) - n + 1 + i]
        bucket = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)
        inside = np.arange(n, len(code) + n, dtype=np.uint32) <= last[: len(code)]
        out += np.bincount((row[: len(code)] + bucket)[inside], minlength=len(out)).astype(np.float32)
    x = np.sqrt(out).reshape(rows, FEATURES)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def code(k: int, seed: int = 5) -> np.ndarray:
    """Codewords of k classes, as rows of -1 and 1: all splits for up to 6 classes, else the random code with the largest least distance."""
    if k <= 6:
        splits = np.arange(1, max(2, 1 << (k - 1)))
        return np.where((splits[None, :] << 1 >> np.arange(k)[:, None]) & 1, 1, -1).astype(np.float32)
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(12 * np.log2(k))), (-1, None)
    for _ in range(50):
        c = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        apart = bits - (c @ c.T + bits) / 2 + bits * np.eye(k)
        best = max(best, (int(apart.min()), c), key=lambda x: x[0])
    return best[1]


class Model:
    def __init__(self, x: np.ndarray, y: list[str]):
        self.langs = sorted(set(y))
        target = np.array([self.langs.index(v) for v in y])
        self.code = code(len(self.langs))
        bits = self.code[target]
        share = 1 / np.bincount(target)[target]
        share = (share / share.sum())[:, None].astype(np.float32)
        self.w, self.b = np.zeros((x.shape[1], bits.shape[1]), np.float32), np.zeros(bits.shape[1], np.float32)
        ahead_w, ahead_b = self.w, self.b
        for step in range(STEPS):
            pull = share * bits / (1 + np.exp(bits * (x @ ahead_w + ahead_b)))
            w = ahead_w + RATE * (x.T @ pull * 8 - PENALTY * ahead_w)
            b = ahead_b + RATE * pull.sum(0)
            momentum = step / (step + 3)
            ahead_w, ahead_b = w + momentum * (w - self.w), b + momentum * (b - self.b)
            self.w, self.b = w, b
        margin = bits * (x @ self.w + self.b)
        self.weight = np.maximum((share * (margin > 0)).sum(0) - 0.5, 1e-3) * 2  # how much better than chance each bit is
        near = self.loss(x)
        self.scale = np.float32(1 / max(1e-3, np.median(np.sort(near, 1)[:, 1] - near.min(1)) / 4)) if len(self.langs) > 1 else np.float32(1)

    def loss(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.w + self.b
        return (np.log1p(np.exp(-margin[:, None, :] * self.code[None])) * self.weight).sum(2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score between 0 and 1."""
        loss = self.loss(x) * self.scale
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), (1 / p.sum(1)).astype(np.float64)


def train(docs: DataFrame, sample: int = SAMPLE, rows: int = ROWS) -> Model | None:
    """A model of at most `sample` labelled texts for each language, and at most `rows` in all unless there are more languages than that; None without any.

    docs: doc_id, text, lang. Rows with a null in any of the three teach nothing; empty texts do not either. Of rows that
    repeat a doc_id one is taken; ties of the hash order are decided by doc_id. Of long texts all n-grams count, of an empty
    table nothing is learned. Other columns are ignored, of whatever name.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text <> '' and lang is not null")
    known = own.select("doc_id", "lang")
    each = known.groupBy("lang").agg(F.count("*").alias("n"))
    sample = max(1, min(sample, rows // max(1, each.count())))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # about four times as many as asked for of each language go on to the ranking, however many there are
    few = known.join(each, "lang").where(place * F.col("n") < F.lit(4.0 * sample * (1 << 30)))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = few.distinct().select("doc_id", "lang", F.row_number().over(order).alias("k")).where(F.col("k") <= sample).select("doc_id", "lang")
    ids = [(r.doc_id, r.lang) for r in ids.collect()]  # at most `sample` for each language
    if not ids:
        return None
    few = spark.createDataFrame(ids, "doc_id long, lang string")
    texts = own.join(F.broadcast(few), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang")

    def run(batches):
        for part, data, offsets in slabs(batches, "text", 1 << 19, 128):
            x = features(data, offsets).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "lang": part.column(2), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    got = texts.mapInArrow(run, "doc_id long, lang string, x binary").groupBy("doc_id", "lang").agg(F.min("x").alias("x")).collect()
    got = sorted((r.lang, bytes(r.x)) for r in got)
    return Model(np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32), [v for v, _ in got])


FIELDS = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predictor(model: Model | None):
    """A function of a text column that gives a struct of lang_pred, score and ambiguous.

    `und` with score 0 if the text is null or has no letter, or if nothing was learned; of ties between languages the first
    by name. Whole texts are read, however long.
    """

    def work(texts, data, offsets):
        n = len(texts)
        plain = np.concatenate(([0], np.cumsum(_ascii_letters[LOWER[data]])))
        letters = plain[offsets[1:]] > plain[offsets[:-1]]
        for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[i] = bool(LETTER.search(texts[i].as_py() or ""))
        lang, score = np.full(n, "und", object), np.zeros(n)
        if model is not None:
            for a in range(0, n, 64):
                b = min(a + 64, n)
                k, p = model.predict(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                lang[a:b], score[a:b] = np.array(model.langs, object)[k], p
            lang[~letters], score[~letters] = "und", 0
        return pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array((score < AMBIGUOUS) & letters)

    return text_column(work, "lang_pred string, score double, ambiguous boolean", FIELDS)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (text and any further columns) with lang_pred, score and ambiguous added, see predictor().

    Null texts and texts without a letter are `und`; long texts are read whole. Of ties between languages
    the first by name is taken. Columns of these names are replaced; predictor() adds none.
    Every row is returned, repeated ones as often as they occur; an empty table gives an empty result.
    """
    names = ("lang_pred", "score", "ambiguous")
    found = docs.drop(*names).withColumn("lang_pred", predictor(model)(F.col("text").cast("string")))
    return found.withColumns({"score": F.col("lang_pred.score"), "ambiguous": F.col("lang_pred.ambiguous")}).withColumn("lang_pred", F.col("lang_pred.lang_pred"))


def fold(column="doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def op5_language_id(spark, sf_dir):
    docs = table(spark, "documents", sf_dir).select("doc_id", "text", "lang")
    model = train(docs.where(fold() != 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
