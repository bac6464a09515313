"""C4 against a fold written down plainly, and on a very long file."""

import random
import re

import pytest

from ledgerline.functions import text as T
from ledgerline.operators import corpus as C

ELEMENT = "source_file string, elem_idx int, page_number int, element_type string, text string"
START = re.compile(rf"\b({T.SECTION_WORDS})\b", re.I)


def strip(s):
    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", s)


def plain(rows, most, least, overlap):
    """Texts of the chunks of one file's elements, in order."""
    blocks, alone_before = [], False
    for _, _, _, kind, text in rows:
        start = kind in ("Title", "Header") or len(text) < 120 and START.search(text)
        alone = kind == "Table" and not start
        if start or alone or alone_before or not blocks:
            blocks.append([alone, [], []])
        blocks[-1][1].append(text)
        blocks[-1][2].append(kind)
        alone_before = alone
    out, lead = [], ""
    for alone, texts, kinds in blocks:
        body = "\n\n".join(texts)
        table = "Table" in kinds
        text = strip(body) if alone else strip(f"{lead}\n\n{body}" if lead else body)
        if len(text) < least:
            lead = lead if alone else ""
            continue
        parts = [text]
        if not table and len(text) > most:
            parts = [""]
            for p in text.split("\n\n"):
                longer = strip(f"{parts[-1]}\n\n{p}" if parts[-1] else p)
                if parts[-1] and len(longer) > most:
                    parts.append(f"{parts[-1][-overlap:]}\n\n{p}" if len(parts[-1]) > overlap else p)
                else:
                    parts[-1] = longer
        out += [p for k, p in enumerate(parts) if k < len(parts) - 1 or len(p) >= least]
        if not alone:
            lead = parts[-1][-overlap:] if len(parts[-1]) > overlap else ""
    return out


def drawn(seed, n):
    draw, rows = random.Random(seed), []
    for i in range(n):
        size = draw.choice([2, 5, 15, 40, 98, 99, 100, 101, 102, 150, 400, 1700])
        words = "".join(draw.choice(["a", "b ", "c", " ", "\n", "\n\n", " \n\n", "d"]) for _ in range(size))
        kind = draw.choices(["NarrativeText", "Title", "Table", "OrgData"], [6, 3, 2, 1])[0]
        rows.append((f"f{seed}", i, i // 20 + 1, kind, ("Budget " if draw.random() < 0.2 else "") + words))
    return rows


@pytest.mark.parametrize("sizes", [(1500, 100, 100), (300, 60, 40)])
def test_sections_as_a_plain_fold(spark, sizes):
    files = {f"f{seed}": drawn(seed, 60) for seed in range(40)}
    got = C.chunk_sections(spark.createDataFrame([r for rows in files.values() for r in rows], ELEMENT), *sizes).collect()
    for name, rows in files.items():
        assert [r.text for r in sorted((r for r in got if r.source_file == name), key=lambda r: r.seq)] == plain(rows, *sizes), name


def test_a_file_of_very_many_elements(spark):
    rows = spark.range(300_000).selectExpr("'big' as source_file", "cast(id as int) as elem_idx", "cast(1 + id div 20 as int) as page_number", "CASE WHEN id % 7 = 0 THEN 'Title' ELSE 'NarrativeText' END as element_type", "concat('part ', id, ' ', repeat('x', 30)) as text")
    got = C.chunk_sections(rows).selectExpr("count(*) as n", "max(seq) + 1 as last", "max(length(text)) as longest", "min(length(text)) as least").first()
    assert got.n == got.last == 42_858 and got.longest < 500 and got.least >= 100


def test_a_file_without_a_name_is_cut_like_others(spark):
    rows = drawn(3, 60)
    named, none = (sorted(tuple(r)[1:] for r in C.chunk_sections(spark.createDataFrame([(n, *r[1:]) for r in rows], ELEMENT)).collect()) for n in ("f", None))
    assert named == none and len(none) > 10


def test_elements_travel_once(spark):
    """one exchange of the elements, no gathering of them a second time."""
    plan = C.chunk_sections(spark.createDataFrame(drawn(1, 9), ELEMENT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_types_with_markers_go_by_their_own(spark):
    draw = random.Random(5)
    words = ["WHEREAS, ", "Resolved: ", " ordained ", "Section 3 ", "other "]
    files = {k: [(k, i, 1, "NarrativeText", draw.choice(words) + "x" * draw.choice([5, 60, 200])) for i in range(80)] for k in ("resolution", "legislation", "minutes")}
    rows = {k: spark.createDataFrame(v, ELEMENT) for k, v in files.items()}
    profiles = spark.createDataFrame([(k, k) for k in files], "source_file string, document_type string")
    got = C.chunk_all(rows["resolution"].union(rows["legislation"]).union(rows["minutes"]), profiles, C.doc_types(spark))
    want = C.chunk_sections(rows["minutes"])
    for k, marks in (("resolution", ["whereas", "resolved"]), ("legislation", ["ordained", "section"])):
        want = want.unionByName(C.chunk_keep_together(rows[k], marks).select(*want.columns))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
