"""Token counts, spelling variants and periodic runs against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from ledgerline.llm import periodic, spelling, token_counts
from ledgerline.llm.tokens import vocabulary

from .helpers import LOW, docs

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [(None, None), (None, "a b"), (1, ""), (2, " \n "), (3, "x" * 200_000), (3, "x" * 200_000), (4, "the " * 60_000), (5, " " * 50_000 + "a"), (6, "1234 !!"), (7, "Ünïcode täxt \x00 ok")]


def given_rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# Token counts

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", " ", "　", "x", "<|endoftext|>", "<|endof", "text|>", "1", "23", "!", "漢字", "😀", "Привет", "\x1c", "\x85", "᠎", "\r\n", "..."]


def by_library(texts):
    from tokenizers import Tokenizer

    return [len(e) for e in Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_remembered_pieces_count_as_whole_texts(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert token_counts.counts(data, offsets, vocabulary("byte_bpe_50k.json")).tolist() == by_library(texts)


@pytest.mark.parametrize("sizes", [{}, {"huge": 1000, "step": 300, "overlap": 60}, {"huge": 200, "step": 70, "overlap": 30}])
def test_token_counts(spark, sizes):
    draw = random.Random(3)
    rows = ODD + [(10 + k, "".join(draw.choices([*ALPHABET, "the ", " of", "ing"], k=draw.randrange(200, 30_000)))) for k in range(12)]
    got = token_counts.count_tokens(docs(spark, rows), vocabulary("byte_bpe_50k.json"), **sizes).collect()
    want = [(i, len((t or "").encode()), n) for (i, t), n in zip(rows, by_library([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_seam_without_a_common_place_widens(spark):
    text = "a b " * 50 + "x" * 5000 + " c d" * 50
    chunks = token_counts.cut(spark.createDataFrame([(0, 1, len(text), text)], "row long, doc_id long, n_bytes long, text string"), 300, 40)
    assert token_counts.spliced(chunks, 40, vocabulary("byte_bpe_50k.json")).first().n_tokens is None
    wider = token_counts.widened(chunks, 300, 320)
    assert [(r.k, r.at, r.last) for r in wider.orderBy("k").collect()] == [(0, 0, False), (1, 2400, False), (2, 4800, True)]
    assert all(text[r.at :].startswith(r.text) and len(r.text) == min(2400 + 320, len(text) - r.at) for r in wider.collect())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count_whole_texts(spark, name):
    texts = ["It's l'été, DON'T", "", " two  words ", "漢字"]
    got = token_counts.count_tokens(docs(spark, list(enumerate(texts))), vocabulary(name), huge=4).orderBy("doc_id").collect()
    if name.endswith("json"):
        from tokenizers import Tokenizer

        want = [len(Tokenizer.from_file(vocabulary(name)).encode(t, add_special_tokens=False)) for t in texts]
    else:
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=vocabulary(name)).encode(t)) for t in texts]
    assert [r.n_tokens for r in got] == want


def test_op11_on_the_tables(spark, sf):
    rows = given_rows(spark, sf)
    got = __spark_entry__.queries()["op11_token_counts"](spark, sf).collect()
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, by_library([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_counts.count_tokens(docs(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


# Spelling variants


def variants(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    near, open_ = {w: set() for w in n}, defaultdict(set)
    for w in n:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            open_[k, less].add(w)
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for same in open_.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b))) if len(a) < len(b) else sum(x != y for x, y in zip(a, b, strict=True)) == 1


@given(st.sets(st.text("abÿ", min_size=3, max_size=6), min_size=2, max_size=20), st.sampled_from([1, 3, 512]))
@settings(max_examples=200, deadline=None)
def test_tiles(words, tile):
    size = max(map(len, words))
    words = sorted(w.encode("latin-1") for w in words if len(w) >= size - 1)
    i, j = spelling.near_pairs(words, size, 0, 0, size + 1, tile)
    want = {(x, y) for y in range(len(words)) for x in range(y) if near(words[x], words[y]) and size in (len(words[x]), len(words[y]))}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


@given(st.binary(max_size=12), st.binary(max_size=48))
def test_checksums(a, b):
    got = spelling.checksums(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("group", [spelling.GROUP, 5])
def test_op12_on_the_tables(spark, sf, group):
    want = variants(given_rows(spark, sf))
    assert want and sorted(map(tuple, spelling.variants(spark.read.parquet(f"{sf}/documents.parquet"), group=group).collect())) == want
    if group == spelling.GROUP:
        assert sorted(map(tuple, __spark_entry__.queries()["op12_spelling_variants"](spark, sf).collect())) == want


def test_variants_of_odd_texts(spark):
    long = "ab" * 400
    rows = ODD + [(20 + k, " ".join([long, long[:-1], long[1:] + "c", "Colour colour color", "naïve naive", "x" * 60, "x" * 59 + "y"] * 2)) for k in range(4)]
    assert sorted(map(tuple, spelling.variants(docs(spark, rows)).collect())) == variants(rows)
    assert spelling.variants(docs(spark, [])).count() == 0


def test_hot_groups_are_halved(spark):
    """Words that all share both halves but two letters."""
    letters = "abcdefghijklm"
    rows = [(k, " ".join(f"intern{x}ation{y}lise" for x in letters for y in letters)) for k in range(4)]
    assert sorted(map(tuple, spelling.variants(docs(spark, rows), group=10).collect())) == variants(rows)


# Periodic runs


def slow_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_summary(i, t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if i is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = slow_runs(w)
    gone = {x for s, size, q in found for x in range(s + q, s + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


words_of_few = st.lists(st.integers(0, 2), max_size=40) | st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=9)).map(lambda x: x[0] * x[1] + x[2])


@given(words_of_few)
@settings(max_examples=500, deadline=None)
def test_lyndon_lengths_and_runs(s):
    longest = [next((j for j in range(i + 1, len(s)) if s[j:] <= s[i:]), len(s)) - i for i in range(len(s))]
    assert periodic.lyndon_lengths(s) == longest
    assert periodic.runs(np.array(s, np.int64)) == slow_runs(s)


@given(st.lists(words_of_few, min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_runs_lie_in_recurring_stretches(rows):
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.uint64)
    found = periodic.recurring(np.array([x for r in rows for x in r], np.uint64), row)
    at = np.cumsum([0, *map(len, rows)])
    for k, r in enumerate(rows):
        for a, n, _ in slow_runs(r):
            assert any(x <= at[k] + a and at[k] + a + n <= y for x, y in found)


def test_op13_on_the_tables(spark, sf):
    want = [slow_summary(i, t) for i, t in given_rows(spark, sf)]
    assert sum(x[1] > 0 for x in want) > 5
    assert sorted(map(tuple, __spark_entry__.queries()["op13_periodic_runs"](spark, sf).collect()), key=str) == sorted(want, key=str)


def test_runs_of_odd_texts(spark):
    rows = ODD + [(11, "a b " * 9 + "c " + "a b c " * 5), (11, "a a a a a"), (11, "A a A a A a A a"), (12, "            ")]
    got = periodic.periodic_runs(docs(spark, rows), rewrite=True)
    assert sorted(map(tuple, got.drop("runs", "collapsed").collect()), key=str) == sorted((slow_summary(i, t) if i != 4 else (4, 1, 0, 60_000, 1, 60_000_000, *many("the", 60_000)) for i, t in rows), key=str)
    assert periodic.periodic_runs(docs(spark, [])).count() == 0
    assert [bytes(r.collapsed) for r in periodic.periodic_runs(docs(spark, [(1, "x  a b a b\na b a b y")])).collect()] == [b"x a b y"]


def many(word, n):
    return hashlib.sha256(f"0,{n},1\n".encode()).hexdigest(), hashlib.sha256(word.encode()).hexdigest()
