"""Queries as they are registered, and the pipeline as a whole, on the given tables against plain Python."""

import hashlib
import os
import re
import zlib

import numpy as np

import __spark_entry__
from ledgerline.llm import language, mixing, pii, tokens
from ledgerline.llm.shared import table

from .test_dedup import near_brute, vectors_brute
from .test_texts import contamination_brute

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def rows_of(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, "documents", sf).select("doc_id", "text").collect()]


def run(spark, sf, name):
    return __spark_entry__.queries()[name](spark, sf).collect()


def ids_of(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 1] for e in Tokenizer.from_file(tokens.vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_op1(spark, sf):
    want = near_brute(rows_of(spark, sf), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, sf, "op1_minhash_near_dedup")} == want


def test_op3(spark, sf):
    rows, start, want = sorted(rows_of(spark, sf)), 0, []
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, sf, "op3_token_output")) == want


def test_op8(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, "embeddings", sf).collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in run(spark, sf, "op8_embedding_near_dedup")) == vectors_brute(rows, 0.98)


def test_op5(spark, sf):
    """Predictions against a decoder that goes through languages and bits one by one."""
    docs = table(spark, "documents", sf).select("doc_id", "text", "lang")
    model = language.train(docs.where(language.fold() != 0))
    got = {r.doc_id: r for r in run(spark, sf, "op5_language_id")}
    for r in docs.collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        if not r.text or not any(c.isalpha() for c in r.text):
            want, score = "und", 0.0
        else:
            data = np.frombuffer(r.text.encode(), np.uint8)
            x = language.features(data, np.array([0, len(data)]))[0].astype(float)
            margins = [float(x @ model.w[:, b].astype(float) + model.b[b]) for b in range(model.w.shape[1])]
            loss = [sum(model.weight[b] * np.log1p(np.exp(-word[b] * m)) for b, m in enumerate(margins)) for word in model.code[: len(model.langs)]]
            want = model.langs[min(range(len(loss)), key=lambda k: (round(loss[k], 4), k))]
            score = 1 / sum(np.exp(float(model.scale) * (min(loss) - x)) for x in loss)
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held, want)
        assert abs(got[r.doc_id].score - score) < 1e-3


def luhn(digits):
    total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def spans(text):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 14 <= len(digits) <= 19 and luhn(digits) or k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op10(spark, sf):
    want = {}
    for i, t in rows_of(spark, sf):
        found = spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
        want[i] = (*(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), set(filter(None, text.split(","))))
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, set(filter(None, r.spans.split(",")))) for r in run(spark, sf, "op10_pii")}
    assert got.keys() == want.keys() and all(got[i][:5] == want[i][:5] and got[i][5] >= want[i][5] for i in want)


def test_pipeline_run(spark, sf):
    """Documents with letters, one of each group of near copies, without benchmark items, in the copies of the mix, as their tokens."""
    rows = table(spark, "documents", sf)
    some = {r.doc_id: r.text for r in rows.collect() if r.text and any(c.isalpha() for c in r.text)}
    kept = sorted(i for i, x in near_brute(sorted(some.items()), 5, 80).items() if x[2])
    bench = [(r.item_id, r.text) for r in table(spark, "benchmark", sf).collect()]
    clean = {r[0] for r in contamination_brute([(i, some[i]) for i in kept], bench, 13) if not r[5]}
    copies = {r.doc_id: r.copies for r in mixing.mix(rows.where(rows.doc_id.isin(sorted(clean)))).collect()}
    got = sorted(run(spark, sf, "pipeline"), key=lambda r: r.start)
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    ids = dict(zip(some, ids_of(list(some.values())), strict=True))
    assert all((r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())) for r in got)
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
