"""Main text of web pages by equivalence classes of tokens, nested to a template whose slots hold what varies.

Every page is cut into tokens: block elements, told apart by the path of open elements they stand in, and text blocks with
their path. Over the pages of a host, tokens with the same occurrence vector (how often in which page) form an equivalence
class. The vector itself is never gathered: its signature, an order-free hash over (page, count), is aggregated for each host
and token, so a host with most of the pages costs no task more than others. The paths of valid classes nest by their own
steps: they are the host's template, and what stands between them are its slots. The slot of the text is chosen by the prose
that slots hold over all pages, in which article elements count more; headings, links, and what always follows the text are further evidence.
Elements for furniture (nav, footer, aside, form, ...) and names made of furniture words alone are left out beforehand.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slabs, table, written

#: Pages that a class needs to be template, and their least share of the host's pages; a host of one page is judged by that page.
PAGES, SHARE = 2, 0.01
#: Pages in which a text must stand, and their least share of the pages with its place, to be template text.
REPEATED, USUAL = 4, 0.5
#: What a character of an article counts as prose.
ARTICLE = 3

# Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas object select option button title head".split())
FURNITURE = RAW | frozenset("nav footer aside form header dialog menu".split())
BOX = frozenset("div section ul ol dl table article".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an element of a name ends, if it is the innermost block.
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "dd", "dt", "li"}
# Words that class and id names of furniture are made of, and words that say nothing. A name counts only if it is made of these alone.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments reply replies respond discussion disqus widget pagination pager byline hidden".split()
)
PLAIN = frozenset("site page main top bottom left right inner outer box slot list item items area block bar wrap wrapper container section group row col unit links link js is has widget reader user".split())
ROLES = frozenset("complementary contentinfo navigation search banner".split())

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
_bare_tag = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*>", re.S)
_opening = re.compile(r"</?[a-zA-Z]")
_attr = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
_word = re.compile(r"[A-Za-z]+|[0-9]+")
_space = re.compile(r"\s+")


def number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def furniture(name: str, attrs: str) -> tuple[bool, str]:
    """Is an element marked as page furniture, and what names it in a path."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return name in FURNITURE, name
    marked, label = name in FURNITURE, [name]
    for m in _attr.finditer(attrs):
        key, value = (m[1] or m[5]).lower(), next((v for v in m.group(2, 3, 4) if v is not None), "")
        if key in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in _word.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", part))]
                words = [w for w in words if not w.isdigit()]
                marked |= any(w in MARKS for w in words) and all(w in MARKS or w in PLAIN for w in words) and name not in ("html", "body", "main", "article")
                label.append(".".join(words))
        elif key == "role":
            marked |= value.lower() in ROLES
        else:
            marked |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower()
    return marked, " ".join(label)


class Element:
    """An open element: its path, the place in the list of paths of the block it is or stands in, where the innermost block is on the stack, and what encloses it."""

    __slots__ = ("article", "block", "chrome", "link", "main", "name", "node", "path", "title")

    def __init__(self, name, path, node, block, article, chrome, link, title, main):
        self.name, self.path, self.node, self.block, self.article, self.chrome, self.link, self.title, self.main = name, path, node, block, article, chrome, link, title, main


def tags(source: str):
    """(start, end, closing, name, attributes) of the tags, comments (without a name) and declarations of a page, in time that grows with its length.

    A tag ends at the first > outside quotes. From the first tag on whose quotes don't close, it ends at the first >. What begins behind the
    last > is text; a comment without an end hides what follows.
    """
    at, last, pattern = 0, source.rfind(">") + 1, _tag
    while True:
        m = pattern.search(source, at, last)
        stop = m.start() if m else last
        if pattern is _tag and _opening.search(source, at, stop):
            pattern = _bare_tag
            continue
        if not m:
            return
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            yield m.start(), len(source), "", "", ""
            return
        skipped = yield m.start(), at, m[1], (m[2] or "").lower(), m[3]
        at = skipped or at


def parse(source: str) -> tuple[list[dict], list[dict]]:
    """Blocks of text in order, and the page's path tokens.

    A block has its text, its token, the place in the list of paths of the block element it stands in, and whether it is in an article, in
    furniture, a heading of the first rank; and how many of its characters are in links. A path token has its count, the place
    of the block around it, the prose (characters outside links and furniture; those of an article count ARTICLE times) below it, and
    whether it is a box of blocks. Takes time in proportion to the page, however deep it nests.
    """
    blocks: list[dict] = []
    paths: dict[int, int] = {0: 0}
    tokens = [{"t": 0, "n": 1, "up": 0, "prose": 0, "box": True}]
    stack = [Element("", 0, 0, 0, 0, False, False, False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        linked += len(raw) * stack[-1].link

    def flush() -> None:
        nonlocal linked
        if parts:
            found = _space.sub(" ", html.unescape("".join(parts))).strip()
            link = min(linked, len(found))
            parts.clear()
            linked = 0
            if found:
                e = stack[-1]
                blocks.append({"text": found, "token": number(e.path, found), "at": e.node, "article": e.article, "chrome": e.chrome, "link": link, "title": e.title})
                if not e.chrome:
                    tokens[e.node]["prose"] += (len(found) - link) * (ARTICLE if e.article == 1 else 1)

    def cut(i: int) -> None:
        opened.subtract(x.name for x in stack[i:])
        del stack[i:]

    at, found, skipped = 0, tags(source), None
    while True:
        try:
            start, end, closing, name, attrs = found.send(skipped)
        except StopIteration:
            break
        skipped = None
        if start > at:
            text(source[at:start])
        at = end
        if not name:
            continue
        block = name in BLOCK
        if block or name in RAW:
            flush()
        if name == "br":
            parts.append(" ")
        if closing:
            if opened[name] > 0:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                cut(i)
            continue
        marked, label = furniture(name, attrs)
        if name == "body":  # a head may have no end
            cut(1)
        if name in CLOSES_P or name in ENDS:
            i = stack[-1].block
            if i and stack[i].name in ENDS.get(name, ("p",)):
                cut(i)
        top = stack[-1]
        if name == "header" and top.article:
            marked = False  # an article's own header
        path = number(top.path, label)
        if path not in paths:
            paths[path] = len(tokens)
            tokens.append({"t": path, "n": 0, "up": top.node, "prose": 0, "box": name in BOX})
        node = paths[path]
        tokens[node]["n"] += 1
        if name in ("script", "style", "textarea", "title") and not attrs.rstrip().endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = skipped = close.end() if close else len(source)
        elif name not in VOID and not (attrs.rstrip().endswith("/") and not block):
            # an article in an article is a reader's comment
            inner = top.article + (name in ("article", "main") and not top.chrome and not (name == "article" and top.main and top.article == 1))
            stack.append(Element(name, path, node if block else top.node, len(stack) if block else top.block, inner, top.chrome or marked or inner > 1, top.link or name == "a", top.title or name == "h1", top.main or name == "main"))
            opened[name] += 1
    text(source[at:])
    flush()
    for x in reversed(tokens[1:]):  # a path stands behind the one around it
        tokens[x["up"]]["prose"] += x["prose"]
    return blocks, tokens


_block = pa.struct([("text", pa.string()), ("token", pa.int64()), ("at", pa.int32()), ("article", pa.int32()), ("chrome", pa.bool_()), ("link", pa.int32()), ("title", pa.bool_())])
_token = pa.struct([("t", pa.int64()), ("n", pa.int32()), ("up", pa.int32()), ("prose", pa.int64()), ("box", pa.bool_())])
PARSED = (
    "row binary, page_id long, url string, host string, blocks array<struct<text:string,token:long,at:int,article:int,chrome:boolean,link:int,title:boolean>>, tokens array<struct<t:long,n:int,up:int,prose:long,box:boolean>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for rows, _, _ in slabs([whole], "html"):
                got = [parse(x or "") for x in rows.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array([x[0] for x in got], pa.list_(_block)), pa.array([x[1] for x in got], pa.list_(_token))], names=["row", "page_id", "url", "host", "blocks", "tokens"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    key = F.unhex(F.md5(F.to_json(F.struct("page_id", "url", "html")).cast("binary")))
    rows = pages.select(key.alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, PARSED)


def templates(rows: DataFrame) -> DataFrame:
    """(host, template, repeated): the path tokens of the host's valid classes with their mean prose and number of pages, and the tokens of template text.

    Tokens, paths and texts alike, are a class if they have the same occurrence vector over the host's pages. A class is valid
    if it stands on enough pages and has two tokens; its paths are template if they occur once a page. Texts are template
    if they stand on enough of the pages that have their place.
    """
    own = rows.where("host <> ''")
    pages = own.groupBy("host").agg(F.count("*").alias("pages"))
    paths = own.select("host", "row", F.explode("tokens").alias("x")).select("host", "row", F.lit(True).alias("path"), "x.t", "x.n", "x.prose", "x.box", F.lit(0).cast("long").alias("place"))
    texts = own.select("host", "row", "tokens", F.explode("blocks").alias("x")).where("not x.chrome")
    texts = texts.groupBy("host", "row", F.lit(False).alias("path"), F.col("x.token").alias("t")).agg(F.count("*").cast("int").alias("n"), F.lit(0).cast("long").alias("prose"), F.lit(False).alias("box"), F.first(F.expr("tokens[x.at].t")).alias("place"))
    seen = paths.unionByName(texts).groupBy("host", "path", "t", "box", "place").agg(F.count("*").alias("in"), F.max("n").alias("most"), F.sum("prose").alias("prose"), F.bit_xor(F.xxhash64("row", "n")).alias("signature"))
    usual = seen.join(pages, "host").where((F.col("in") >= F.greatest(F.lit(PAGES), F.col("pages") * SHARE)) | (F.col("pages") == 1))
    vector = ["host", "in", "signature"]
    classes = usual.groupBy(*vector).agg(F.count("*").alias("members")).where("members >= 2").drop("members")
    valid = usual.where("path and most = 1").join(classes, vector, "left_semi")
    nodes = valid.groupBy("host").agg(F.collect_list(F.struct("t", (F.col("prose") / F.col("in")).alias("prose"), F.col("in").alias("pages"), "box")).alias("template"))
    places = seen.where("path").select("host", F.col("t").alias("place"), F.col("in").alias("of"))
    often = seen.where(~F.col("path") & (F.col("in") >= REPEATED)).join(places, ["host", "place"]).where(F.col("in") >= F.col("of") * USUAL)
    return nodes.join(often.groupBy("host").agg(F.collect_set("t").alias("repeated")), "host", "left")


def main_text(blocks: list[dict], paths: list[int], up: list[int], template: dict[int, dict], repeated: set[int]) -> list[str]:
    """The blocks of the slot that holds the article.

    The search goes from the page inward, as long as one slot of the template holds most of the prose, where an article's counts
    more, and no heading of the first rank is left behind; it ends where all is an article's. In the slot, articles that hold most of
    it are the text. Of that, template text goes, and so do the boxes that only hold links, or that always follow the article's own
    prose and hold less of it.
    """
    body = [b for b in blocks if not b["chrome"] and b["token"] not in repeated]
    if not body:
        return []
    # the template's boxes as a tree: the nearest one around each path, and the stretch of blocks that each holds, which stand together as it occurs once
    box = [i == 0 or ((t := template.get(p)) is not None and t["box"]) for i, p in enumerate(paths)]
    near = [0] * len(paths)
    for i in range(1, len(paths)):
        near[i] = i if box[i] else near[up[i]]
    first, last = [len(body)] * len(paths), [-1] * len(paths)
    for k, b in enumerate(body):
        i = near[b["at"]]
        first[i], last[i] = min(first[i], k), k
    inside: dict[int, list[int]] = {}
    for i in range(len(paths) - 1, 0, -1):
        if box[i] and last[i] >= 0:
            j = near[up[i]]
            first[j], last[j] = min(first[j], first[i]), max(last[j], last[i])
            inside.setdefault(j, []).append(i)
    weight = lambda b: (len(b["text"]) - b["link"]) * (ARTICLE if b["article"] == 1 else 1)
    prose, titles, others = ([0, *accumulate(f(b) for b in body)] for f in (weight, lambda b: b["title"], lambda b: b["article"] != 1))
    node = 0
    lo, hi = 0, len(body)
    while others[hi] - others[lo] and node in inside:
        # what the page's slots hold over all pages, and what the page has between them
        slots = inside[node]
        here = sum(template[paths[i]]["prose"] - prose[last[i] + 1] + prose[first[i]] for i in slots) + prose[hi] - prose[lo]
        best = max(reversed(slots), key=lambda i: template[paths[i]]["prose"])
        if template[paths[best]]["prose"] < 0.5 * here or titles[hi] - titles[lo] > titles[last[best] + 1] - titles[first[best]]:
            break
        node, lo, hi = best, first[best], last[best] + 1
    slot = [b for b in body[lo:hi] if b["article"] == 1]
    slot = slot if 2 * sum(map(weight, slot)) >= prose[hi] - prose[lo] and slot else body[lo:hi]
    # the boxes of the template in the slot: of each block the outermost that does not hold all of it
    whole = [0] * len(paths)
    for b in slot:
        whole[near[b["at"]]] += 1
    for i in range(len(paths) - 1, 0, -1):
        if box[i]:
            whole[near[up[i]]] += whole[i]
    outer = [-1] * len(paths)
    for i in range(1, len(paths)):
        if box[i]:
            above = outer[near[up[i]]]
            outer[i] = above if above >= 0 else i if whole[i] < len(slot) and template[paths[i]]["pages"] >= REPEATED else -1
    boxes: dict[int, list[int]] = {}
    for k, b in enumerate(slot):
        if outer[near[b["at"]]] >= 0:
            boxes.setdefault(outer[near[b["at"]]], []).append(k)
    held = {k for ks in boxes.values() for k in ks}
    direct = [k for k in range(len(slot)) if k not in held]
    size = lambda ks: sum(len(slot[k]["text"]) for k in ks)
    own, gone = size(direct), set()
    for ks in boxes.values():
        links = sum(slot[k]["link"] for k in ks)
        behind = direct and min(ks) > direct[-1] and 2 * size(ks) < own
        if 2 * links > size(ks) or behind:
            gone.update(ks)
    return [b["text"] for k, b in enumerate(slot) if k not in gone]


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    The blocks of the article's slot, see main_text(), in page order, one a line. Null and empty html give an empty text, as
    does a page without main text; long, deep and broken ones are read whole, in time that grows with their length. Pages without a host are judged by themselves, as is the page
    of a host that has no other. Repeated rows are each returned, and of a host they count as pages; equal texts in one page
    are each kept. Further columns are ignored, of whatever name; an empty table gives an empty result.
    """
    rows = written(parsed(pages), "pages")
    found = rows.join(written(templates(rows), "templates"), "host", "left").select("page_id", "url", "blocks", F.transform("tokens", lambda x: x["t"]).alias("paths"), F.transform("tokens", lambda x: x["n"]).alias("n"), F.transform("tokens", lambda x: x["up"]).alias("up"), "template", "repeated", "tokens", "host")

    def run(batches):
        known: tuple = (None, {}, set())
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b, out = whole.slice(start, 64), []
                for blocks, paths, counts, up, template, repeated, tokens, host in zip(*(b.column(i).to_pylist() for i in range(2, 10)), strict=True):
                    if not host or template is None:
                        nodes, texts = {t["t"]: {"prose": t["prose"], "pages": 1, "box": t["box"]} for t in tokens if t["n"] == 1}, set()
                    else:
                        if known[0] != host:
                            known = (host, {x["t"]: x for x in template}, set(repeated or ()))
                        _, nodes, texts = known
                        once = {p for p, n in zip(paths, counts, strict=True) if n == 1}
                        nodes = {p: nodes[p] for p in once if p in nodes}
                    out.append("\n".join(main_text(blocks, paths, up, nodes, texts)))
                yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    return found.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir):
    return extract(table(spark, "pages", sf_dir))
