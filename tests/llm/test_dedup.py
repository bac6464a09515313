import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import embedding_dedup, minhash, shared, suffix_dedup

from .helpers import docs, least_reachable, shingles


def near_brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    comp = least_reachable(sets, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def check_near(spark, rows, k, percent):
    got = minhash.near_duplicates(docs(spark, rows), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near_brute(rows, k, percent)
    assert len(got) == len(rows)


def test_near_copies(spark):
    rng = np.random.default_rng(1)
    word = [f"w{i}" for i in range(3000)]
    rows, base = [], list(rng.choice(word, 120))
    for i in range(60):  # a group of copies with edits, from none to many
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 12)):
            text[at] = rng.choice(word)
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(rng.choice(word, rng.integers(1, 60)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "One"), (204, "one"), (205, "a b"), (206, "A  B"), (207, "b a"), (208, "z " * 30000), (209, "z " * 25000)]
    check_near(spark, rows, 3, 85)
    check_near(spark, rows, 5, 80)


def test_near_copies_of_the_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check_near(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 3, 85)


def test_near_copies_edges(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    got = minhash.near_duplicates(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, False), (1, True), (1, True)]


def test_tiny_sets_meet_in_bands(spark):
    full = [f"w{i}" for i in range(9)]
    rows = [(0, " ".join(full)), (1, " ".join(full[:8]))]  # 7 and 6 shingles: 6 of 7
    for shift in range(20):
        rows += [(10 * shift + 10, " ".join(f"{w}x{shift}" for w in full)), (10 * shift + 11, " ".join(f"{w}x{shift}" for w in full[:8]))]
    check_near(spark, rows, 3, 85)


def test_exhaustive_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        text = list(base)
        for at in rng.integers(0, 100, rng.integers(2, 9)):
            text[at] = f"e{i}_{at}"
        rows.append((i, " ".join(text)))
    check_near(spark, rows, 3, 85)


def test_blocks_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHINGLES", 250)
    test_exhaustive_search_in_blocks(spark, monkeypatch)


def test_unite():
    rng = np.random.default_rng(8)
    for _ in range(30):
        i, j = rng.integers(0, 60, (2, rng.integers(0, 50)))
        low = np.arange(60)
        embedding_dedup.unite(low, i, j)
        want = least_reachable(range(60), list(zip(i.tolist(), j.tolist(), strict=True)))
        assert low.tolist() == [want[k] for k in range(60)]


def test_registers_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:3600]), np.unique(pool[400:])
    x, y = minhash.registers([a, b])
    assert abs(minhash.estimate((x == y).mean(), np.array(3600), np.array(3600)) - 0.8) < 0.16


def test_near_copies_with_and_without_an_empty_bucket(spark):
    rng, rows, sizes = np.random.default_rng(9), [], []
    cuts = np.arange(minhash.REGISTERS, dtype=np.uint64) << np.uint64(57)
    while len(rows) < 160:
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, rng.integers(400, 1200))]
        copy = list(base)
        for at in rng.integers(0, len(base), int(len(base) * rng.uniform(0.008, 0.026))):
            copy[at] += "x"
        data = [" ".join(t).encode() for t in (base, copy)]
        a, b = shared.shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 3)
        both = len(np.intersect1d(a, b))
        full = [len(np.unique(np.searchsorted(cuts, s, "right"))) == minhash.REGISTERS for s in (a, b)]
        if full[0] != full[1] and 0.85 <= both / (len(a) + len(b) - both) <= 0.95:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
            sizes += [len(a), len(b)]
    assert min(sizes) < 500 and max(sizes) > 700
    check_near(spark, rows, 3, 85)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)]
    want = least_reachable({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    got = shared.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


def repeats_brute(texts, window):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check_repeats(spark, rows, window, hot=suffix_dedup.HOT):
    got = suffix_dedup.drop_repeats(docs(spark, rows).repartition(3), window, hot).collect()
    want = sorted(zip([i for i, _ in rows], repeats_brute([t for _, t in rows], window), strict=True), key=str)
    assert sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got), key=str) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 20, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "PIECE", 900)
    rng = np.random.default_rng(5)
    some = lambda n: "".join(rng.choice(list("abcdé "), n))
    p, q = some(150), some(90)
    rows = [(i, some(rng.integers(0, 300)) + [p, q, p[20:], p + q, ""][i % 5] + some(rng.integers(0, 200))) for i in range(40)]
    rows += [(100, "a" * 700), (101, "ab" * 400), (102, None), (103, ""), (104, p), (105, p), (105, p), (106, q[:64]), (107, "x" + p[:70] + "y" + p[60:]), (108, some(4000) + p + some(500))]
    check_repeats(spark, rows, 64, hot)


def test_repeats_of_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text").collect()]
    check_repeats(spark, [*rows, (9000, rows[3][1]), (9001, rows[4][1][:700] + "x")], 400)


def test_op2_on_whole_tables(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(zip([i for i, _ in rows], repeats_brute([t for _, t in rows], 400), strict=True))
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.op2_suffix_dedup(spark, sf).collect()) == want


def test_ranges_are_joined_before_they_are_collected(spark):
    rows = [(b"a", i, i + 400) for i in range(0, 5000)] + [(b"a", 9000, 9400), (b"a", 9000, 9500), (b"a", 9500, 9900), (b"a", 9901, 9902), (b"b", 0, 400), (b"b", 0, 400)]
    got = suffix_dedup.joined_ranges(spark.createDataFrame(rows, "row binary, start long, end long").repartition(3)).collect()
    assert sorted((bytes(r.row), r.start, r.end) for r in got) == [(b"a", 0, 5399), (b"a", 9000, 9900), (b"a", 9901, 9902), (b"b", 0, 400)]


def test_repeats_empty(spark):
    assert suffix_dedup.drop_repeats(docs(spark, [])).count() == 0


def vectors_brute(rows, cosine):
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        x = np.array([np.nan if t is None else t for t in v], np.float64) if v is not None else np.zeros(1)
        if label is not None and np.isfinite(x).all() and np.any(x):
            unit[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links, pairs = Counter(), []
    for a, b in itertools.combinations(unit, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            links[a] += 1
            links[b] += 1
            pairs.append((rows[a][0], rows[b][0]))
    comp = least_reachable({r[0] for r in rows}, pairs)
    return sorted((r[0], links[i], comp[r[0]], comp[r[0]] == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    rng, rows = np.random.default_rng(6), []
    for i in range(150):
        v = rng.standard_normal(12) if i % 3 == 0 else np.array(rows[rng.integers(0, len(rows))][1]) + rng.standard_normal(12) * rng.choice([0, 0.05, 0.1, 0.15])
        rows.append((int(i), [float(x) for x in np.float32(v)], int(rng.integers(0, 3)) if i % 11 else None))
    rows += [(200, None, 1), (201, [0.0] * 12, 1), (202, [None] + [1.0] * 11, 1), (203, [float("nan")] * 12, 1), (204, [float("inf")] * 12, 1), (205, rows[3][1], rows[3][2]), (206, [x * 4 for x in rows[3][1]], rows[3][2]), (207, [1.0, 2.0], 1), (208, [1.0, 2.0], 1), (209, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, 0.98).collect())
    assert got == vectors_brute(rows, 0.98)


def test_several_vectors_of_one_id_are_one_node(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 1), (1, b, 1), (2, a, 1), (3, b, 1), (4, c, 1), (None, a, 1), (5, a, 2)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()
    # both rows of id 1 have the links of either, which join 2 and 3
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    assert [(r.n_links, r.kept) for r in got if r.vec_id is None] == [(0, False)]


def test_vectors_empty(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_planted_passages_of_400_bytes_go_and_others_stay(spark):
    """The size of the input is no sign of removal; n_removed is."""
    draw = random.Random(3)
    words = lambda k: " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(k))
    passages = [words(draw.randint(51, 120)) for _ in range(20)]
    texts = [f"{words(80)}\n{p}\n{words(80)}" for p in passages for _ in (0, 1)] + [words(240) for _ in range(10)]
    got = {r.doc_id: r for r in suffix_dedup.drop_repeats(docs(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        planted = len(passages[k // 2]) + 2 if k < 40 else 0  # with the line ends
        assert (got[k].n_bytes, got[k].n_removed > 0) == (len(text), planted >= 400)
