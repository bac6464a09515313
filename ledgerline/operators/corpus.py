"""Corpus preparation: page gates and routing (P1 to P22), chunking (C1 to C5), request packing and response assembly."""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ledgerline.functions import text as T
from ledgerline.sources.scratch import written

VECTOR_TYPES = {"narrative": (True, False, False), "table": (True, True, True), "metrics": (True, True, False), "org_data": (True, False, True), "project": (True, False, True), "header": (True, False, False)}

# Built-in document types as (content vocabulary, record tables, keep-together markers, anchor field).
DOC_TYPES = {
    "quarterly_report": (["narrative", "table", "metrics", "org_data", "project", "header"], ["expenditures", "metrics", "grants", "vacancies", "goals", "projects"], [], None),
    "resolution": (["legal_authorization", "whereas_clause", "vote_record", "narrative", "header"], ["resolutions", "votes"], ["whereas", "resolved"], "resolution_number"),
    "minutes": (["narrative", "roll_call", "agenda_action", "header"], ["meetings", "meeting_actions"], [], None),
    "legislation": (["legal_authorization", "ordinance_clause", "narrative", "header"], ["legislation"], ["ordained", "section"], "bill_number"),
    "budget": (["table", "narrative", "metrics", "header"], ["appropriations"], [], None),
}
#: White space as regular expressions of the engine know it.
SPACE = " \t\n\x0b\f\r"
CHUNK = ["source_file", "seq", "page_number", "section", "element_type", "text"]
#: Chunks that a task hands on at once.
SLICE = 1024
BUDGET_PHRASES = "approved budget|proposed budget|adopted budget|annual budget"


def doc_types(spark) -> DataFrame:
    rows = [(k, *v) for k, v in DOC_TYPES.items()]
    return spark.createDataFrame(rows, "name string, content_vocab array<string>, sql_targets array<string>, keep_together array<string>, anchor_field string")


def joined_in_order(value: str, order: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)


def page_kind(pages: DataFrame) -> DataFrame:
    """Reader class per file, of pages (source_file, page_number, text)."""
    n = F.length(F.coalesce("text", F.lit("")))
    per = pages.groupBy("source_file").agg(F.avg(F.when(F.col("page_number") <= 5, n)).alias("density"), F.max(F.when(F.col("page_number") == 1, T.garbled_ratio(F.coalesce("text", F.lit(""))))).alias("garbled"))
    name = F.lower("source_file")
    kind = F.when(name.rlike(r"\.docx?$"), "word_doc").when(~name.endswith(".pdf"), "other").when((F.col("density") < 100) | (F.col("garbled") > 0.10), "complex_pdf").otherwise("clean_text_pdf")
    return per.select("source_file", kind.alias("kind"))


def ocr_quality(pages: DataFrame) -> DataFrame:
    """Enough characters a page, and few garbled ones."""
    text = F.coalesce("text", F.lit(""))
    per = pages.groupBy("source_file").agg((F.sum(F.length(text)) / F.count("*")).alias("per_page"), (F.sum(T.garbled_ratio(text) * F.length(text)) / F.nullif(F.sum(F.length(text)), F.lit(0))).alias("garbled"))
    return per.select("source_file", ((F.col("per_page") >= 150) & (F.coalesce("garbled", F.lit(0.0)) < 0.10)).alias("ok"))


def sparse_parse(elements: DataFrame, least: int = 200) -> DataFrame:
    """Files with little text."""
    return elements.groupBy("source_file").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).select("source_file", (F.col("chars") < least).alias("sparse"))


def parser_route(files: DataFrame) -> DataFrame:
    """The next reader of files (kind, ocr_ok, sparse, garbled, reader)."""
    nxt = (
        F.when(F.col("kind") == "other", "none")
        .when(F.col("kind") == "complex_pdf", F.when(F.col("ocr_ok"), "ocr").otherwise("vision"))
        .when(F.col("sparse"), "vision")
        .otherwise("text")
    )
    return files.withColumn("next_reader", F.when(F.col("garbled") & (nxt != "none"), "vision").otherwise(nxt))


def split_blocks(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages as elements, numbered per file."""
    rows = pages.select("source_file", "page_number", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    order = Window.partitionBy("source_file").orderBy("page_number", "pos")
    return rows.select("source_file", (F.row_number().over(order) - 1).alias("elem_idx"), "page_number", F.lit("NarrativeText").alias("element_type"), "text")


KNOWN = ("Title", "Header", "NarrativeText", "Table", "ListItem", "Footer", "OrgData")


def element_clean(elements: DataFrame) -> DataFrame:
    """Blank elements go, unknown types become NarrativeText, a missing page is the count of page breaks so far plus one."""
    order = Window.partitionBy("source_file").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, 0)
    page = F.coalesce("page_number", F.count_if(F.col("element_type") == "PageBreak").over(order) + 1)
    rows = elements.withColumn("page_number", page.cast("int")).where("element_type is null or element_type <> 'PageBreak'").where("trim(coalesce(text, '')) <> ''")
    return rows.withColumn("element_type", F.when(F.col("element_type").isin(*KNOWN), F.col("element_type")).otherwise("NarrativeText"))


def people_elements(pages: DataFrame) -> DataFrame:
    """P10: one OrgData element for each named person of pages (source_file, page_number, people array<struct<name,title>>)."""
    rows = pages.select("source_file", "page_number", F.posexplode("people").alias("pos", "p")).where("trim(coalesce(p.name, '')) <> ''")
    return rows.select("source_file", "page_number", "pos", F.lit("OrgData").alias("element_type"), F.concat_ws(" — ", F.trim("p.name"), F.nullif(F.trim("p.title"), F.lit(""))).alias("text"))


def vocab_check(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """Labels outside their type's vocabulary become its first entry; without a vocabulary, narrative."""
    label = F.lower(F.trim("content_type"))
    vocab = F.broadcast(types.select(F.col("name").alias("document_type"), "content_vocab"))  # one row per document type
    first = F.coalesce(F.try_element_at("content_vocab", F.lit(1)), F.lit("narrative"))
    fixed = F.when(F.array_contains("content_vocab", label), label).otherwise(first)
    return chunks.join(vocab, "document_type", "left").withColumn("content_type", fixed).drop("content_vocab")


def store_routing(chunks: DataFrame) -> DataFrame:
    """P14."""
    for i, store in enumerate(("vector", "sql", "graph")):
        chunks = chunks.withColumn(f"to_{store}", F.coalesce(F.col("content_type").isin(*(k for k, v in VECTOR_TYPES.items() if v[i])), F.lit(False)))
    return chunks


def snapshot_year(rows: DataFrame) -> DataFrame:
    """Year of the file name where a row has none of its own."""
    return rows.withColumn("roster_year", F.coalesce("roster_year", F.nullif(F.regexp_extract("source_file", r"(20[0-9]{2})", 1), F.lit("")).cast("int")))


def chunk_metadata(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Index and total per file, with type, department and period of the profile."""
    per, order = Window.partitionBy("source_file"), Window.partitionBy("source_file").orderBy("seq")
    parts = T.split_period(F.coalesce("period", F.lit("")))
    p = profiles.select("source_file", F.col("document_type").alias("_t"), F.col("department").alias("_d"), parts["quarter"].alias("quarter"), parts["year"].alias("year"))
    rows = chunks.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long")).withColumn("total_chunks", F.count("*").over(per))
    rows = rows.join(p, "source_file", "left").withColumn("document_type", F.coalesce("_t", F.lit("unclassified"))).withColumn("department", F.coalesce("_d", F.lit("Unknown Department")))
    return rows.withColumn("chunk_id", F.left(F.sha2(F.concat_ws("\u0001", "source_file", "chunk_index"), 256), F.lit(32))).drop("_t", "_d")


def quarantine(profiles: DataFrame, types: DataFrame, least: float = 0.55) -> DataFrame:
    """Profiles with `quarantined` and its reason; such files only go to the vector store and raise a flag."""
    known = F.broadcast(types.select(F.col("name").alias("document_type"), F.lit(True).alias("_known")))  # one row per document type
    reason = F.when(F.col("document_type") == "unclassified", "unclassified").when(F.col("_known").isNull(), "unregistered type").when(F.col("confidence") < least, "low confidence")
    return profiles.join(known, "document_type", "left").withColumn("reason", reason).withColumn("quarantined", reason.isNotNull()).drop("_known")


def excerpt(elements: DataFrame, pages: int = 3, chars: int = 8000) -> DataFrame:
    """P20: the first characters of the first pages."""
    return elements.where(F.col("page_number") <= pages).groupBy("source_file").agg(F.left(joined_in_order("text", "elem_idx", "\n"), F.lit(chars)).alias("excerpt"))


def coerce_ids(c: Column) -> Column:
    """A map of id lists as a map of comma-joined ids, empty ones dropped."""
    flat = F.transform_values(c, lambda k, v: F.array_join(F.filter(v, lambda x: F.trim(x) != ""), ", "))
    return F.map_filter(flat, lambda k, v: v.isNotNull() & (v != ""))


def annual_budget_gate(profiles: DataFrame) -> DataFrame:
    """Budget documents whose title and file name hold none of the phrases do not qualify."""
    named = F.lower(F.concat_ws(" ", "title", "source_file")).rlike(BUDGET_PHRASES)
    return profiles.where((F.col("document_type") != "budget") | named)


def clip(df: DataFrame, limits: dict[str, int] = T.LIMITS) -> DataFrame:
    """P25: strings cut to their column's limit."""
    strings = {f.name for f in df.schema if isinstance(f.dataType, ST.StringType)}
    return df.select(*(F.left(c, F.lit(limits[c])).alias(c) if c in strings and c in limits else F.col(c) for c in df.columns))


# Chunking -----------------------------------------------------------------------------------------------------------


def dominant() -> Column:
    """C5 over a group of elements: Table, else OrgData, else the first element's type."""
    has = lambda k: F.bool_or(F.col("element_type") == k)
    return F.when(has("Table"), "Table").when(has("OrgData"), "OrgData").otherwise(F.min_by("element_type", "elem_idx"))


def chunk_pages(elements: DataFrame, least: int = 100) -> DataFrame:
    """One chunk per page."""
    head = F.min_by(F.when(F.col("element_type").isin("Title", "Header"), F.left("text", F.lit(80))), F.when(F.col("element_type").isin("Title", "Header"), F.col("elem_idx")))
    per = elements.groupBy("source_file", "page_number").agg(F.trim(joined_in_order("text", "elem_idx", "\n\n")).alias("text"), head.alias("head"), dominant().alias("element_type"))
    section = F.coalesce("head", F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    return per.where(F.length("text") >= least).select("source_file", F.col("page_number").alias("seq"), "page_number", section.alias("section"), "element_type", "text")


def opening() -> Column:
    return F.ltrim(F.lower(F.left("text", F.lit(60))))


def kept_together(elements: DataFrame, opens: Column, closes: Column, least: int) -> DataFrame:
    """C3 with given marks: a new chunk at an element that opens if one that closes came since the previous opening."""
    before = Window.partitionBy("source_file").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)
    last_open, last_close = F.max(F.when(opens, F.col("elem_idx"))).over(before), F.max(F.when(closes, F.col("elem_idx"))).over(before)
    rows = elements.withColumn("cut", (opens & last_close.isNotNull() & (last_open.isNull() | (last_close > last_open))).cast("int"))
    rows = rows.withColumn("seq", F.sum("cut").over(before.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    per = rows.groupBy("source_file", "seq").agg(
        F.min_by("page_number", "elem_idx").alias("page_number"), F.left(F.trim(F.min_by("text", "elem_idx")), F.lit(80)).alias("section"), dominant().alias("element_type"), joined_in_order("text", "elem_idx", "\n\n").alias("text")
    )
    return per.where(F.length("text") >= least)


def chunk_keep_together(elements: DataFrame, markers: list[str], least: int = 100) -> DataFrame:
    """A new chunk at an element that opens with the first marker if the last marker came since the previous opening."""
    return kept_together(elements, opening().startswith(markers[0].lower()), opening().startswith(markers[-1].lower()), least)


def section_start() -> Column:
    return F.col("element_type").isin("Title", "Header") | ((F.length("text") < 120) & F.col("text").rlike(rf"(?i)\b({T.SECTION_WORDS})\b"))


def blocks(elements: Iterator[tuple]) -> Iterator[tuple[list[tuple], bool]]:
    """The elements (source_file, page_number, element_type, text, start) of one file gathered to blocks: a section's text up to a table or the next section, or a table by itself (True)."""
    held, alone_before = [], False
    for e in elements:
        alone = e[2] == "Table" and not e[4]
        if held and (e[4] or alone or alone_before):
            yield held, alone_before
            held = []
        held.append(e)
        alone_before = alone
    yield held, alone_before


def pieces(text: str, most: int, overlap: int) -> list[str]:
    """A text cut between paragraphs, each piece opening with the end of the one before."""
    done = [""]
    for paragraph in text.split("\n\n"):
        last = done[-1]
        longer = (f"{last}\n\n{paragraph}" if last else paragraph).strip(SPACE)
        if last and len(longer) > most:
            done.append(f"{last[len(last) - overlap :]}\n\n{paragraph}" if len(last) > overlap else paragraph)
        else:
            done[-1] = longer
    return done


def sections(elements: Iterator[tuple], most: int, least: int, overlap: int) -> Iterator[tuple]:
    """Chunks (source_file, seq, page_number, section, element_type, text) of elements that come file by file and in order. Null texts are left out."""
    for file, own in itertools.groupby(elements, operator.itemgetter(0)):
        seq, section, lead = 0, "Introduction", ""
        for block, alone in blocks(own):
            _, page, first, head, start = block[0]
            if start and head is not None:
                section = head.strip(SPACE)[:80]
            kinds = {e[2] for e in block}
            kind = "Table" if "Table" in kinds else "OrgData" if "OrgData" in kinds else first
            body = "\n\n".join(e[3] for e in block if e[3] is not None)
            text = (f"{lead}\n\n{body}" if lead and not alone else body).strip(SPACE)
            if len(text) < least:
                lead = lead if alone else ""
                continue
            parts = [text] if kind == "Table" or len(text) <= most else pieces(text, most, overlap)
            for part in parts[:-1] if len(parts[-1]) < least else parts:
                yield file, seq, page, section, kind, part
                seq += 1
            if not alone:
                lead = parts[-1][len(parts[-1]) - overlap :] if len(parts[-1]) > overlap else ""


def chunk_sections(elements: DataFrame, most: int = 1500, least: int = 100, overlap: int = 100) -> DataFrame:
    """C4: chunks at section boundaries; tables whole and alone; long text cut between paragraphs; each chunk opens with the last characters of the one before.

    What a block opens with depends on all blocks of the file before. So elements go past in order, and a file's last characters are
    carried from one block to the next: a file of any number of blocks takes no more memory than its longest block and a batch of rows.
    """

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        chunks = sections(rows, most, least, overlap)
        while part := list(itertools.islice(chunks, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=CHUNK)

    rows = elements.select("source_file", F.col("page_number").cast("int"), "element_type", "text", F.coalesce(section_start(), F.lit(False)).alias("start"), "elem_idx")
    rows = rows.repartition("source_file").sortWithinPartitions("source_file", "elem_idx", "text").drop("elem_idx")
    return rows.mapInArrow(run, "source_file string, seq int, page_number int, section string, element_type string, text string")


def chunk_all(elements: DataFrame, profiles: DataFrame, types: DataFrame) -> DataFrame:
    """Pages of files read by vision, keep-together types by their markers, sections for the others."""
    hints = types.select(F.col("name").alias("document_type"), "keep_together")
    per = profiles.select("source_file", "document_type").join(F.broadcast(hints), "document_type", "left")  # one row per document type
    rows = elements.join(per, "source_file", "left")
    vision = F.coalesce(F.col("reader") == "vision", F.lit(False)) if "reader" in elements.columns else F.lit(False)
    together = F.coalesce(F.size("keep_together") > 0, F.lit(False))
    out = chunk_pages(rows.where(vision)).select(*CHUNK)
    # all types with markers in one pass, each with its own
    marks = {name: markers for name, (_, _, markers, _) in DOC_TYPES.items() if markers}
    opens, closes = (F.coalesce(*(F.when(F.col("document_type") == name, opening().startswith(m[k].lower())) for name, m in marks.items())) for k in (0, -1))
    out = out.unionByName(kept_together(rows.where(~vision & F.col("document_type").isin(*marks)), opens, closes, 100).select(*CHUNK))
    return out.unionByName(chunk_sections(rows.where(~vision & ~together)))


# Requests and responses ---------------------------------------------------------------------------------------------


def pack_fixed(chunks: DataFrame, n: int = 8) -> DataFrame:
    """Batches of n chunks per report, with their texts; reports are numbered in order of their names."""
    rows = chunks.withColumn("b", F.floor((F.row_number().over(Window.partitionBy("source_file").orderBy("seq")) - 1) / n).cast("long"))
    per = rows.groupBy("source_file", "b").agg(F.count("*").alias("n"), joined_in_order("text", "seq", "\n\n---\n\n").alias("request"))
    report = numbered(per.select("source_file").distinct(), "source_file", "report")
    return per.join(report, "source_file").select("source_file", F.concat(F.lit("r"), F.col("report"), F.lit("_b"), (F.col("b") * n).cast("string")).alias("batch_id"), "n", "request")


def numbered(names: DataFrame, by: str, number: str) -> DataFrame:
    """Distinct names with their place in order: the place in a range partition plus the sizes of the partitions before."""
    low = (1 << 33) - 1
    placed = written(names.repartitionByRange(by).sortWithinPartitions(by).select(by, F.monotonically_increasing_id().alias("_at")), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # one row for each range partition, a number set by configuration
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    return placed.join(bases, "_part").select(by, (F.col("_base") + F.col("_at").bitwiseAND(low) + 1).alias(number))


def pack_char_budget(chunks: DataFrame, budget: int = 24_000) -> DataFrame:
    """Batch number per chunk; a batch closes before the chunk that would exceed the budget, unless it is empty.

    Where a batch closes depends on all chunks of the file before. So lengths, and only they, go past in order, and two numbers are carried
    from one to the next: a file of any number of chunks takes no more memory than a batch of rows. A null text has no length.
    """

    def run(batches):
        file, number, used = run, 0, 0  # a file that is no name
        for b in batches:
            out = []
            for name, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if name != file:
                    file, number, used = name, 0, 0
                elif used > 0 and used + n > budget:
                    number, used = number + 1, 0
                used += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], names=["source_file", "seq", "batch"])

    lengths = chunks.select("source_file", F.col("seq").cast("int").alias("seq"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return lengths.repartition("source_file").sortWithinPartitions("source_file", "seq").mapInArrow(run, "source_file string, seq int, batch int")


def slice_reports(reports: DataFrame, skip: int, limit: int) -> DataFrame:
    """A slice of the reports in a fixed order."""
    ordered = reports.orderBy("department", "year", "quarter", "source_file")
    return ordered.offset(skip).limit(limit)


def cost_estimate(requests: DataFrame, tokens_in: int = 3384, tokens_out: int = 1559, price=(3.0, 15.0), share: float = 0.5) -> DataFrame:
    """X4."""
    return requests.agg(F.count("*").alias("requests"), F.bround(F.count("*") * ((tokens_in * price[0] + tokens_out * price[1]) / 1e6 * share), 4).alias("cost"))


def parse_response(responses: DataFrame, target: str, fields: str, required: list[str]) -> DataFrame:
    """Rows of one record table in responses (report_id, batch_id, raw): the JSON between the first and last brace; rows
    with a required field missing or a confidence below medium go, and so does what cannot be parsed."""
    body = F.expr("substring(raw, instr(raw, '{'), length(raw) - instr(reverse(raw), '}') - instr(raw, '{') + 2)")
    parsed = F.from_json(body, f"{target} array<struct<{fields}, confidence: string>>")
    rows = responses.where("instr(raw, '{') > 0 and instr(raw, '}') > 0").select("report_id", "batch_id", F.posexplode(parsed.getField(target)).alias("pos", "r")).select("report_id", "batch_id", "pos", "r.*")
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    return rows.where(F.lower("confidence").isin("high", "medium"))


def merge_parts(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows of all batches of a report, without TOTAL lines and repeats, stamped with the report's period."""
    if "line_item" in rows.columns:
        rows = rows.where(~F.coalesce(F.upper(F.ltrim("line_item")).startswith("TOTAL"), F.lit(False)))
    rows = rows.drop("source_text", "confidence", "batch_id", "pos", "department", "quarter", "year").dropDuplicates()
    return rows.join(reports.select("report_id", "department", "quarter", "year"), "report_id")


def dedup_projects(projects: DataFrame, by: list[str]) -> DataFrame:
    """Of one project name, the row with the longest description, the first if tied."""
    w = Window.partitionBy(*by, F.lower(F.trim("project_name"))).orderBy(F.length(F.coalesce("description", F.lit(""))).desc(), "id")
    return projects.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_type_parts(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Rows (source_file, document_type, target, record) of declared targets, each once."""
    declared = F.broadcast(types.select(F.col("name").alias("document_type"), F.explode("sql_targets").alias("target")))  # a few rows per document type
    return rows.join(declared, ["document_type", "target"], "left_semi").dropDuplicates(["source_file", "target", "record"])


def anchor_guard(rows: DataFrame, profiles: DataFrame, anchor: str) -> DataFrame:
    """Where the profile has an id, one row per file: the one whose anchor is that id, else the first; it gets the id."""
    rows = rows.join(profiles.select("source_file", F.col("anchor_id")), "source_file", "left")
    w = Window.partitionBy("source_file").orderBy((F.coalesce(F.col(anchor) == F.col("anchor_id"), F.lit(False))).desc(), "id")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("anchor_id is null or _n = 1")
    return rows.withColumn(anchor, F.coalesce("anchor_id", anchor)).drop("_n", "anchor_id")


def validate_resolution(resolutions: DataFrame, votes: DataFrame, files: DataFrame, most_votes: int = 15) -> DataFrame:
    """(source_file, problem) of resolution files."""
    num = F.trim(F.coalesce("resolution_number", F.lit("")))
    bad = F.when(~num.rlike(r"^[0-9]{1,4}-[0-9]{4}$"), F.concat(F.lit("resolution_number '"), num, F.lit("' is not of the form N-YYYY")))
    bad = bad.when(F.substring_index(num, "-", 1) == F.substring_index(num, "-", -1), F.concat(F.lit("resolution_number '"), num, F.lit("' has sequence equal to year (impossible)")))
    out = resolutions.select("source_file", bad.alias("problem")).where("problem is not null")
    many = votes.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") > most_votes).select("source_file", F.concat(F.lit("implausible vote count: "), F.col("n").cast("string")).alias("problem"))
    none = files.select("source_file").distinct().join(resolutions, "source_file", "left_anti").select("source_file", F.lit("no resolution row extracted").alias("problem"))
    return out.unionByName(many).unionByName(none)


def withhold_invalid(rows: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X11: rows of files without problems, and one flag per file with problems."""
    flags = problems.groupBy("source_file").agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("detail")).withColumn("stage", F.lit("validate"))
    return rows.join(problems.select("source_file").distinct(), "source_file", "left_anti"), flags


def complete_batches(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (report_id, n_batches) with the parsed batches and whether the report is complete."""
    got = parts.groupBy("report_id").agg(F.count_distinct("batch_id").alias("parsed"))
    return expected.join(got, "report_id", "left").withColumn("parsed", F.coalesce("parsed", F.lit(0))).withColumn("complete", F.col("parsed") == F.col("n_batches"))


def stamp_meeting_date(meetings: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions without a date get that of their file's first meeting."""
    first = meetings.groupBy("source_file").agg(F.min_by("meeting_date", "id").alias("_d"))
    return actions.join(first, "source_file", "left").withColumn("meeting_date", F.coalesce("meeting_date", "_d")).drop("_d")


def merge_graph_parts(rows: DataFrame) -> DataFrame:
    """Rows (source_file, kind, name, seq): people, departments and projects once per name, the first wins; others as they are."""
    once = F.col("kind").isin("person", "department", "project")
    w = Window.partitionBy("source_file", "kind", "name").orderBy("seq")
    one = rows.where(once & (F.coalesce("name", F.lit("")) != "")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.unionByName(rows.where(~once))


# Names and types that data-driven tables may use.
COLUMN_TYPE = r"^(TEXT|VARCHAR\([0-9]+\)|INTEGER|DECIMAL\([0-9]+, *[0-9]+\)|DATE|BOOLEAN)$"
RESERVED = ("select", "from", "where", "table", "user", "order", "group", "insert", "update", "delete", "drop")
MANAGED = ("id", "source_chunk_id", "source_file", "ingested_at")


def check_specs(specs: DataFrame) -> DataFrame:
    """Specs (table, seq, column, type) with `problem`, null if the column is usable. Managed columns are ignored, of repeated names the first stands."""
    once = F.row_number().over(Window.partitionBy("table", "column").orderBy("seq"))
    ident = lambda c: F.col(c).rlike(r"^[a-z][a-z0-9_]{0,62}$") & ~F.col(c).isin(*RESERVED)
    problem = F.when(~ident("table"), "bad table name").when(F.col("column").isin(*MANAGED), "managed column").when(~ident("column"), "bad column name").when(~F.upper("type").rlike(COLUMN_TYPE), "bad type").when(F.col("_n") > 1, "repeated column")
    return specs.withColumn("_n", once).withColumn("problem", problem).drop("_n")


def typed_from_specs(records: DataFrame, checked: list[tuple[str, str]]) -> DataFrame:
    """Records (source_file, record map<string,string>) as typed columns; checked: (column, type) of one table, from its few spec rows."""
    types = {"TEXT": "string", "VARCHAR": "string", "INTEGER": "int", "DATE": "date", "BOOLEAN": "boolean"}
    kind = lambda t: types.get(t.upper().split("(")[0], t.lower())
    return records.select("source_file", *(F.try_element_at("record", F.lit(c)).try_cast(kind(t)).alias(c) for c, t in checked))


def approve_types(proposals: DataFrame, decisions: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals with their decision, and the registry with a row for each approved type in place of any of its name."""
    decided = proposals.join(decisions.select("id", "approve", "note"), "id", "left")
    status = F.when(F.col("approve"), "approved").when(~F.col("approve"), "rejected").otherwise(F.col("status"))
    decided = decided.withColumn("status", status).withColumn("reviewer_note", F.col("note")).drop("note")
    fresh = decided.where("approve").select(F.col("proposed_type").alias("name"), F.array_distinct("tables").alias("sql_targets"), F.lit(True).alias("active"))
    return decided.drop("approve"), registry.join(fresh, "name", "left_anti").unionByName(fresh)


def active_types(registry: DataFrame, builtin: DataFrame) -> DataFrame:
    """X17."""
    return registry.where("active").join(builtin.select("name"), "name", "left_anti")
