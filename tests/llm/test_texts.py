import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat, decontaminate, html_extract, language, pii, tokens

from .helpers import LOW, docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = [(1, None), (2, ""), (3, "   "), (4, "1234 !!"), (5, "x" * 200_000), (5, "x" * 200_000), (6, "Ünïcode täxt \x00 ok")]


# Tokens


@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]), max_size=2000))
@settings(max_examples=30, deadline=None)
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    shard = tokens.Shard(tokens.encode(np.array([7]), np.array([len(ids)]), ids))
    assert (shard.document(0) == ids).all()
    assert all(shard.token(i) == ids[i] for i in range(0, len(ids), 37))
    assert (shard.slice(len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2]).all()


@pytest.mark.parametrize("shard", [tokens.SHARD, 50])
def test_tokens(spark, sf, shard):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80").collect()] + [(1000 + i, t) for i, t in ODD] + [(None, "last?"), (900, "It's l'été, DON'T; ΟΔΟΣ. 'tis é. ½x² … #tag")]
    path = tokens.write_tokens(docs(spark, rows), tokens.vocabulary(), shard=shard)
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(tokens.vocabulary()), 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.ids == ids
        start += len(ids)
    assert tokens.read_tokens(spark, tokens.write_tokens(docs(spark, []), tokens.vocabulary())).count() == 0


def test_tokens_in_given_order(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()][::-1] + [(1, None), (1, "")]
    docs(spark, rows).repartitionByRange(3, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), F.col("text").desc()).write.parquet(str(tmp_path / "d"))
    files = spark.read.parquet(str(tmp_path / "d"))
    assert tokens.in_files(files) and not tokens.in_files(docs(spark, rows))
    got = tokens.read_tokens(spark, tokens.write_tokens(files, tokens.vocabulary(), given=True, shard=900)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _ in sorted(rows, key=lambda x: (-x[0], x[1] is None))]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0


def whole_and_by_word(texts):
    data = [t.encode() for t in texts]
    ids, n = tokens.ids_of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), tokens.vocabulary())
    got = np.split(ids, np.cumsum(n)[:-1])
    return all(x.tolist() == e.ids for x, e in zip(got, tokens.tokenizer(tokens.vocabulary())[0].encode_batch(texts, add_special_tokens=False), strict=True))


def test_whole_and_by_word_agree(spark, sf):
    assert tokens.by_word(tokens.vocabulary()) and not tokens.by_word(tokens.vocabulary("byte_bpe_50k.json"))
    assert whole_and_by_word([r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()])


@given(st.lists(st.one_of(st.sampled_from([*".,;:!?%#*$& \n\t\x1c\x85\xa0'<>|/", "İ", "יִ", "क़", "H\u0331", "J\u030c", "ß", "Σ", "A", "z", "9", "<|endoftext|>", "<|EndOfText|>", "</w>", "'S"]), st.characters(exclude_categories=["Cs"])), max_size=12).map("".join))
@settings(max_examples=1500, deadline=None)
def test_any_text_by_word(text):
    assert whole_and_by_word([text, "x", text + "!"])


def test_words_that_change_under_normalisation():
    assert whole_and_by_word(["İ!", "İ.", "İ,", "יִ;", "क़.", "H\u0331.", "T\u0308 x", "x <|EndOfText|> y", "a<|endoftext|>b <|startoftext|>. <|StartOfText|>, don", "É<|EndOfText|>", "<| A |> <|END", "", " "])


def test_other_tokenizers_take_whole_texts():
    path, texts = tokens.vocabulary("byte_bpe_50k.json"), ["It is.\n 12 é", "", "x  y"]
    from tokenizers import Tokenizer

    data = [t.encode() for t in texts]
    ids, n = tokens.ids_of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_memory_forgets_the_older_half():
    m = tokens.Memory(4)
    for w in (b"a", b"b", b"c"):
        m.put(w, w)
    assert m.get([b"a", b"c", b"x"]) == [b"a", b"c", None]
    m.put(b"d", b"d")
    m.put(b"e", b"e")
    assert m.get([b"b"]) == [None]


# Decontamination


def contamination_brute(rows, bench, window):
    find = lambda t: WORD.findall((t or "").translate(LOW))
    patterns = {}
    for item, t in bench:
        w = find(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[j : j + window]), set()).update(set() if item is None else {item})
    out = []
    for i, t in rows:
        w, hit, items = find(t), set(), set()
        for m in {len(p) for p in patterns}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in patterns:
                    hit |= set(range(j, j + m))
                    items |= patterns[tuple(w[j : j + m])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 3])
def test_contamination(spark, broadcast):
    rng = np.random.default_rng(8)
    some = lambda n: " ".join(rng.choice(["ab", "cd", "Ef", "gh", "é1"], n))
    bench = [(i, some(rng.integers(3, 12))) for i in range(12)] + [(12, "zz"), (13, None), (14, " - "), (None, "cd cd"), (12, "yy zz"), (15, "ab, AB.ab")]
    rows = [(i, some(rng.integers(1, 80)) + "; " + (bench[i % 12][1] if i % 3 == 0 else "")) for i in range(60)] + [(100 + i, t) for i, t in ODD] + [(200, "zz"), (201, "ab ab-ab")]
    b = spark.createDataFrame([(*x, "t") for x in bench], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(docs(spark, rows), b, window=5, broadcast=broadcast).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == contamination_brute(rows, bench, 5)


def test_contamination_of_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in decontaminate.op4_decontamination(spark, sf).collect()), key=str) == contamination_brute(rows, bench, 13)


def test_clean_keeps_columns(spark):
    names = "doc_id long, text string, found string, row int, n_hit int"
    df = spark.createDataFrame([(1, "a b c", "x", 1, 2), (1, "q", "x", 1, 2), (None, None, None, None, None)], names)
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    got = decontaminate.clean(df, bench)
    assert got.columns == df.columns and sorted((r.text or "" for r in got.collect())) == ["", "q"]


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert not decontaminate.contamination(docs(spark, [(1, "a")]), none).first().contaminated


# Language


def test_language_held_out(spark, sf):
    df = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = language.op5_language_id(spark, sf.replace("sf0.001", "sf0.01")).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_language_edges(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(df)
    got = language.identify(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)][:4] == ["und"] * 4
    assert all(r.lang_pred in model.langs for r in got if r.doc_id >= 5)
    assert language.identify(docs(spark, []), model).count() == 0
    assert language.train(df.limit(0)) is None and language.identify(docs(spark, [(1, "abc")]), None).first().lang_pred == "und"


def test_language_columns_and_ties(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    again = df.unionByName(df).withColumn("lang_pred", F.lit("mine"))
    a, b = language.train(df, rows=40), language.train(again, rows=40)
    assert a.langs == b.langs and np.array_equal(a.w, b.w)
    got = language.identify(again.withColumn("score", F.lit("x")), a)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"] and got.count() == again.count() and got.where("lang_pred = 'mine'").isEmpty()


def test_codewords():
    assert language.code(4).shape == (4, 7) and language.code(2).shape == (2, 1)
    c = language.code(12)
    assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= 8


# HTML

PAGE = """<html><head><title>T</title><body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">We use</div><main><article><h1>Head &amp; line</h1><p>One <b>two</b>
 three<p title="a > b">Four &lt;b&gt; &eacute;<br>five<ul><li>a<li>b</ul><aside>side</aside><form>name</form><div id="comments"><p>nice!</p></div></article></main><footer>f</footer><script>var a="<p>no</p>"</script></html>"""


def test_extraction(spark):
    rows = [(1, "https://a.example/x", PAGE), (2, "https://a.example/y", None), (3, None, "<p>bare <!-- x --> text"), (4, "u", ""), (5, "u", "<article>" + "<p>x" * 5000), (5, "u", "<article>" + "<p>x" * 5000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == "Head & line\nOne two three\nFour <b> é five\na\nb"
    assert got[2].text == got[4].text == "" and got[3].text == "bare text" and got[5].n_chars == 9999
    assert html_extract.extract(df).count() == 6 and html_extract.extract(df.limit(0)).count() == 0


def test_template_text_goes(spark):
    page = "<body><div><p>Always here</p><p>Page {0} text</p><p>And the end</p></div></body>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(20)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {i: f"Page {i} text" for i in range(20)}


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_names_do_not_decide_alone(spark):
    page = '<article><div class="content social-policy"><p>Real body.</p></div><section id="comment-on-budget"><p>The budget.</p></section><div class="ad-box">Buy</div><div id="comments"><p>me</p></div><article><p>a reader</p></article></article>'
    assert extracted(spark, [("http://one.example/", page)]) == ["Real body.\nThe budget."]
    assert extracted(spark, [("u", '<body class="sidebar"><main class="menu"><p>Text</p></main></body>')]) == ["Text"]


def test_comments_without_a_name(spark):
    page = "<body><div class='a1'><h1>Head {0}</h1><p>{1}</p><p>{1}</p><div class='q7'>{2}</div></div><div class='z3'><p>Elsewhere {0}</p></div></body>"
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(60)) + "."
    note = lambda i: "".join(f"<p>Nice {i} {k}</p>" for k in range(1 + i % 4))
    got = extracted(spark, [(f"http://many.example/{i}", page.format(i, text(i), note(i))) for i in range(20)])
    assert got == [f"Head {i}\n{text(i)}\n{text(i)}" for i in range(20)]
    small = extracted(spark, [(f"http://few.example/{i}", page.format(i, text(i), "")) for i in range(2)])
    assert small == [f"Head {i}\n{text(i)}\n{text(i)}" for i in range(2)]


def test_two_layouts_of_one_host(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    a = "<body><div class='m'><a href='x'>Home</a></div><div class='c'><p>{0}</p></div><div class='f'><p>All rights reserved by us</p></div></body>"
    b = "<body><div class='k'><p>Our other notice to all</p></div><section><h1>T{1}</h1><p>{0}</p></section></body>"
    got = extracted(spark, [(f"http://two.example/{i}", (b if i % 2 else a).format(text(i), i)) for i in range(16)])
    assert got == [f"T{i}\n{text(i)}" if i % 2 else text(i) for i in range(16)]


def test_extraction_of_the_tables(spark, sf):
    def plain(source):
        body = re.search(r"<article>(.*)</article>", source, re.S)[1].replace("<br>", " ")
        lines = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body))
        return "\n".join(x for x in lines if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_extract.op6_html_extraction(spark, sf).collect()
    assert len(got) == len(pages) and all(r.text == plain(pages[r.page_id]) for r in got)


# Chat

texts = st.lists(st.sampled_from(["<", "\\", "|", "s>", "/s>", "<SYS>>", "[", "INST]", "/INST]", "</SYS>>", "a", "\n", "<|end|>", "<|image:0|>"]), max_size=14).map("".join)


@given(texts)
@settings(max_examples=500, deadline=None)
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(x in safe for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_op7_on_the_tables(spark, sf):
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = chat.op7_chat_format(spark, sf).collect()
    assert {r.conv_id for r in got} == set(convs) and len(got) == len(convs)
    for r in got:
        loss = "".join(t for role, t in convs[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(convs[r.conv_id]), digest("".join(f"{a}\n{b}\n" for a, b in convs[r.conv_id])), len(loss), digest(loss))


def test_long_and_repeated_turns(spark):
    long = "x<|end|>" * 50_000
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame([(1, 0, "assistant", long), (1, 0, "assistant", long), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len(long) and got[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()


def test_neighbouring_parts_make_no_control_string():
    v = chat.Flatten()
    for text in ("<", "|end|>", "<|turn|>assistant"):
        v.visit({"type": "text", "text": text})
    v.visit({"type": "image", "ref": "r"})
    v.visit({"type": "text", "text": "|end|>"})
    out = v.close()
    assert "<|end|>" not in out and "<|turn|>" not in out and chat.parse(f"<|turn|>user<|text|>{out}<|end|>")[1][0] == ("<|end|><|turn|>assistant", True)


def test_conversations(spark):
    turns = [(1, 1, "assistant", "b <|end|>"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "x</s>"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\na\nassistant\nb <|end|>\n\n\n") and got[1].loss_sha256 == digest("b <|end|>") and got[1].n_turns == 3
    assert got[2].loss_chars == 5 and got[None].loss_chars == 0
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 60, 28, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 2), ("text", " <|image:0|>", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    row = chat.format_turns(df).first()
    assert [(a.kind, a.ref, a.place, a.tokens) for a in row.attachments] == [("image", "i.png", 0, 3), ("audio", "a.wav", 1, 38), ("document", "d.pdf", 2, 1024)]
    assert row.extra_tokens == 3 + 38 + 1024
    assert chat.parse(row.formatted) == ("user", [("see ", True), ("<|image:0|>", False), ("", True), ("<|audio:1|>", False), ("", True), ("<|document:2|>", False), (" <|image:0|>", True)])


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def spans_brute(t):
    n = lambda s: sum(c in "0123456789" for c in s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= n(m[0]) <= 19 and pii.luhn(pii.digits_of(m[0]))] + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= n(m[0]) <= 15]
    return sorted(out)


@given(st.lists(st.sampled_from(["a", "@", ".", "b.c", "1", "25", "300", "-", " ", "+", "(555)", "4111111111111111", "é", "%", "\n", "0007"]), max_size=25).map("".join))
@settings(max_examples=600, deadline=None)
def test_patterns(text):
    assert pii.base_spans(text) == spans_brute(text)


def test_personal_data(spark, sf):
    df = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    network = pii.train(df)
    got = pii.find(df, network, redact=True).join(df.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        base = spans_brute(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
        assert not base or r.redacted != r.text
    extra = sum(r.spans.count(":") // 2 - r.n_email - r.n_ip - r.n_card - r.n_phone for r in got)
    assert extra <= 0.05 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    rows = [*ODD, (7, "so call (555) 123-4567 or 1 (017) 555-7713 again; write to foo.22 @ mail3.example.com soon")]
    found = {r.doc_id: r.spans for r in pii.find(docs(spark, rows), network).collect()}
    assert found[1] == found[2] == found[3] == "" and ("phone:" in found[7] or "email:" in found[7])
    assert pii.find(docs(spark, []), network).count() == 0 and pii.train(df.limit(0)) is None


def test_gradients():
    rng, net = np.random.default_rng(1), pii.Network()
    x, y = rng.integers(0, 20, (7, 3)), np.zeros((7, 3), np.int64)
    y[2], y[3] = 1, 2
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss, grad = net.step(x, y)
    for k in net.p:
        i = tuple(rng.integers(0, n) for n in net.p[k].shape) if k != "tr" else (0, 1)
        net.p[k][i] += 1e-3
        more, _ = net.step(x, y)
        net.p[k][i] -= 1e-3
        assert abs((more - loss) / 1e-3 - grad[k][i]) < 2e-2 * max(1, abs(grad[k][i]))


def test_windows_cover_triggers():
    text = "a" * 1000 + "7" + "b" * 500 + "@"
    starts = pii.windows_of(text)
    for i in (1000, 1501):
        assert any(s + pii.STEP // 2 <= i < s + pii.STEP // 2 + pii.STEP for s in starts)


def test_runs_of_windows_are_decoded_as_one():
    net, rng = pii.Network(3), np.random.default_rng(4)
    text = "".join(rng.choice(list("ab1@. "), 700))
    starts = pii.windows_of(text)
    score, mass = np.zeros((len(text) + 2 * pii.WINDOW, pii.TAGS)), np.zeros((len(text) + 2 * pii.WINDOW, 1))
    for s in starts:
        e = net.emissions(pii.padded(text, [s]).T)[0][:, 0]
        w = np.minimum(np.arange(1, 129), np.arange(128, 0, -1))[:, None]
        score[s + 64 : s + 64 + 128] += e * w
        mass[s + 64 : s + 64 + 128] += w
    lo, hi = starts[0] + 64, starts[-1] + 64 + 128
    want = net.decode((score / np.maximum(mass, 1))[lo:hi, None].astype(np.float32))[0]
    at, tag = net.tags(["", text, "no trigger"])[1]
    assert (at == np.arange(len(text))).all() and (tag == want[at + 64 - lo]).all()


def test_long_runs_are_decoded_in_pieces(monkeypatch):
    net, rng = pii.Network(3), np.random.default_rng(4)
    text = "".join(rng.choice(list("ab1@. "), 20_000))
    whole, tags = net.tags([text])[0]
    monkeypatch.setattr(pii, "PIECE", 32)
    at, cut = net.tags([text])[0]
    assert (at == whole).all() and (cut == tags).mean() > 0.999
    pieces = pii.pieces(list(range(100)))
    assert sorted({k for run, _, _ in pieces for k in run}) == list(range(100)) and max(len(run) for run, _, _ in pieces) == 32


def test_copies_do_not_crowd_out_the_sample(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 2)
    texts = spark.range(200_000).selectExpr("concat('mail a', id % 50, '@b.org or call +1 555 000 ', 1000 + id % 50) as text")
    assert pii.train(texts) is not None


def test_rare_spans_are_still_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 2)
    texts = spark.range(20_000).selectExpr("if(id = 777, 'write to someone@example.org', concat('number ', id)) as text")
    assert pii.train(texts) is not None
    assert pii.train(texts.where("text like 'number%'")) is None


def test_parts_of_unknown_types_are_attachments(spark):
    parts = [{"type": "video<|end|>", "ref": "v1"}, {"type": None, "text": "hi"}]
    row = chat.format_turns(spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")).first()
    assert row.formatted == "<|turn|>user<|text|><|document:0|>hi<|end|>" and row.extra_tokens == 0
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("video<|end|>", "v1", 0)]


PROSE = " ".join(f"Sentence {i} tells something of the day." for i in range(30))


def pages_of(spark, bodies, host="h.example"):
    return spark.createDataFrame([(i, f"https://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_a_misleading_article_is_not_the_text(spark):
    """A teaser is marked as the article, the text isn't: the template's slot decides."""
    bodies = [f"<div class='alpha'><article><p>Read our teaser {i}.</p></article></div><div class='beta'><h1>Title {i}</h1><p>{PROSE} Page {i}.</p></div>" for i in range(8)]
    assert [r.text for r in html_extract.extract(pages_of(spark, bodies)).orderBy("page_id").collect()] == [f"Title {i}\n{PROSE} Page {i}." for i in range(8)]


def test_an_article_around_comments_or_none_at_all(spark):
    comments = lambda i: "".join(f"<article><p>Reader {k} of {i} says this and that, at some length.</p></article>" for k in range(3))
    bodies = [f"<div class='alpha'><article><h1>Title {i}</h1><p>{PROSE} Page {i}.</p>{comments(i)}</article></div>" for i in range(6)]
    bodies += [f"<div class='gamma'>Top {i}</div><div class='delta'><p>{PROSE} Bare {i}.</p></div>" for i in range(6)]
    got = [r.text for r in html_extract.extract(pages_of(spark, bodies)).orderBy("page_id").collect()]
    assert got == [f"Title {i}\n{PROSE} Page {i}." for i in range(6)] + [f"{PROSE} Bare {i}." for i in range(6)]


def test_two_articles_of_a_page_are_both_text(spark):
    bodies = [f"<div class='alpha'><article><p>One {i}. {PROSE}</p></article><article><p>Two {i}. {PROSE}</p></article></div>" for i in range(6)]
    assert [r.text for r in html_extract.extract(pages_of(spark, bodies)).orderBy("page_id").collect()] == [f"One {i}. {PROSE}\nTwo {i}. {PROSE}" for i in range(6)]


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<i>" * 50_000 + "<p>a</p>" * 50_000, "<b>x</i>" * 100_000, "<a " * 100_000, "<a '" * 100_001 + ">", "<!" * 100_000, "<p>" * 100_000 + "</div>" * 100_000, "<" * 200_000])
def test_deep_and_broken_pages_take_linear_time(page):
    import time

    start = time.process_time()
    blocks, tokens = html_extract.parse(page)
    paths, up = [t["t"] for t in tokens], [t["up"] for t in tokens]
    html_extract.main_text(blocks, paths, up, {t["t"]: {"prose": t["prose"], "pages": 1, "box": t["box"]} for t in tokens if t["n"] == 1}, set())
    assert time.process_time() - start < 10
