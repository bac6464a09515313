"""Column expressions over text, names, periods and statuses. All are native functions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, phrases, patterns and limits that the rules are stated in.
STOPWORDS = (
    "the of and to a in for is on that by this with be as at or an shall hereby whereas resolved city council mayor department agreement authorize authorized "
    "resolution ordinance section meeting member vote year"
).split()
TITLES = r"council\s*member|councilmember|councilman|councilwoman|council\s*president|vice\s+president|president|mrs|mr|ms|dr|hon|honorable"
ALIASES = {
    "planning bureau": "planning",
    "finance": "budget & finance",
    "park maintenance": "parks & recreation",
    "economic development & building & housing": "building & housing development",
    "codes health department": "codes",
}
VOTES = {
    "yea": "yea", "yeas": "yea", "yes": "yea", "aye": "yea", "ayes": "yea", "y": "yea", "for": "yea", "in favor": "yea",
    "nay": "nay", "nays": "nay", "no": "nay", "noes": "nay", "n": "nay", "against": "nay",
    "abstain": "abstain", "abstained": "abstain", "abstention": "abstain", "abstentions": "abstain",
    "absent": "absent", "away": "absent",
}
COMPLETED = ("complete", "done", "achieved", "finished", "closed", "met")
ACTIVE_GRANT = ("active", "in_progress", "open", "pending", "awarded")
CLOSED_GRANT = ("closed", "complete", "expired", "terminated", "ended")
RESOLUTION_TYPES = (
    ("land_development", r"land development|subdivision|zoning|plat|rezon"),
    ("grant_action", r"grant"),
    ("contract", r"agreement|contract|professional services|purchase|negotiat|lease"),
    ("budget", r"budget|appropriat|millage|\btax\b"),
    ("appointment", r"appoint|reappoint|resign|confirm"),
)
GRANT_STATUS = {"active": "Active", "awarded": "Awarded", "applied": "Proposed", "pending": "Proposed", "closed": "Closed"}
CORPORATE = r"llc|l\.l\.c|inc|incorporated|co|company|corp|corporation|lp|llp|pllc"
CONTENT_WORDS = {
    "org": r"manages?|director|reports\s+to|led\s+by|superintendent|commissioner|chief|captain|lieutenant|coordinator|administrator|officer|supervisor|president|vice\s+president",
    "grant": r"grant|award|funding|reimbursement|federal|state\s+funds?",
    "budget": r"budget|expenditure|expended|appropriation|encumbrance|account\s+number|revised\s+budget|ytd|year[\s-]to[\s-]date",
    "vacancy": r"vacancy|vacancies|vacant|position|hire|hiring|unfilled|open\s+position",
    "project": r"project|capital|construction|renovation|infrastructure|phase\s+\d|bid|contract",
}
SECTION_WORDS = (
    "description|background|mission|quarterly summary|executive summary|metrics|counts|performance indicators|statistics|budget|expenditure|financial|annual goal|goals and objectives|"
    "special project|capital project|vacancy|staffing|personnel|positions|community engagement|outreach|grant|funding"
)
LIMITS = {
    "department": 100, "sub_department": 100, "account_number": 50, "line_item": 200, "metric_name": 200, "metric_unit": 50, "grant_name": 255, "grant_number": 100, "status": 50,
    "position_title": 200, "project_name": 300, "funding_source": 200, "quarter": 5, "resolution_number": 50, "vendor": 255, "council_member": 120, "sponsor": 255, "bill_number": 50,
    "session_type": 60, "president": 120, "call_to_order": 20, "adjourned": 20, "item_type": 30, "item_number": 50, "action": 150, "committee": 120, "fund": 100, "category": 150,
}


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def garbled_ratio(text: Column) -> Column:
    """Share of characters outside ASCII and general punctuation; 0 for empty text."""
    odd = F.length(F.regexp_replace(text, r"[\x00-\x7F\u2000-\u206F]", ""))
    return F.coalesce(odd / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def numeric_ratio(text: Column) -> Column:
    """Digits and , $ % . over characters that are not white space; 0 without any."""
    solid = F.regexp_replace(text, r"\s", "")
    return F.coalesce((F.length(solid) - F.length(F.regexp_replace(solid, r"[0-9,$%.]", ""))) / F.nullif(F.length(solid), F.lit(0)), F.lit(0.0))


def readability(text: Column) -> Column:
    """P5: 0.8 min(1, 3 stopword rate) + 0.2 plausible rate; plausible words have 2 to 15 letters and a vowel; 0 without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    n = F.nullif(F.size(words), F.lit(0))
    stop = F.size(F.filter(words, lambda w: F.array_contains(F.array(*map(F.lit, STOPWORDS)), w)))
    good = F.size(F.filter(words, lambda w: F.length(w).between(2, 15) & w.rlike("[aeiou]")))
    return F.coalesce(F.least(F.lit(1.0), stop * 3 / n) * 0.8 + good / n * 0.2, F.lit(0.0))


def is_garbled(text: Column, least: float = 0.35) -> Column:
    """P6."""
    return readability(text) < least


def content_rule(kind: Column, text: Column, ratio: Column | None = None) -> Column:
    """The first rule that fits names the content type; NULL if none does. ratio: the text's numeric_ratio as a column, if there is one."""
    n, r = F.length(text), numeric_ratio(text) if ratio is None else ratio
    # most words are ruled out by their first letter
    has = {k: text.rlike(rf"(?i)\b(?=[{''.join(sorted({w[0] for w in v.split('|')}))}])({v})\b") for k, v in CONTENT_WORDS.items()}
    return (
        F.when(kind == "Table", "table")
        .when(kind.isin("Title", "Header"), "header")
        .when(kind == "OrgData", "org_data")
        .when(r > 0.6, "metrics")
        .when((r > 0.15) & has["budget"], "table")
        .when((n < 600) & has["org"], "org_data")
        .when(has["grant"] & ~has["org"], "table")
        .when(has["vacancy"], "table")
        .when((n > 100) & has["project"], "project")
        .when((r < 0.05) & (n > 150), "narrative")
    )


def filename_meta(name: Column, as_of_year: int) -> dict[str, Column]:
    """Department, quarter and year from '… - Dept_Qn YYYY.pdf'; otherwise each by itself, with defaults."""
    full = r"(?i)- ([^-]+?)_Q([0-9]) ([0-9]{4})\.pdf$"
    some = lambda c: F.nullif(c, F.lit(""))
    dept = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(name, full, 1)), r"(?i)\s+Q[0-9]\s+[0-9]{4}.*$", ""), r"\s+[0-9]{4}.*$", "")
    rest = F.regexp_replace(F.regexp_replace(name, r"(?i)Misc\.\s+Documents\s+-\s+Quarterly Reports\s+-\s+[0-9]{4}\s+-\s+", ""), r"_Q[0-9].*$", "")
    edge = r"^[ _()-]+|[ _()-]+$"
    matched = name.rlike(full)
    quarter = F.when(matched, F.regexp_extract(name, full, 2)).otherwise(F.regexp_extract(name, r"(?i)_Q([0-9])\s+[0-9]{4}", 1))
    year = F.when(matched, F.regexp_extract(name, full, 3)).otherwise(F.regexp_extract(name, r"\b(20[0-9]{2})\b", 1))
    return {
        "department": F.coalesce(some(F.regexp_replace(F.when(matched, dept).otherwise(rest), edge, "")), F.lit("Unknown Department")),
        "quarter": F.coalesce(F.concat(F.lit("Q"), some(quarter)), F.lit("Q?")),
        "year": F.coalesce(some(year).cast("int"), F.lit(as_of_year)),
    }


def split_period(period: Column) -> dict[str, Column]:
    """Quarter ('' if absent) and year (NULL if absent) of a period text."""
    year = F.regexp_extract(period, r"\b(20[0-9]{2})\b", 1)
    return {"quarter": F.upper(F.regexp_extract(period, r"(?i)(Q[1-4])", 1)), "year": F.nullif(year, F.lit("")).cast("int")}


def strict_date(c: Column) -> Column:
    """YYYY-MM-DD dates only, else NULL."""
    return F.try_to_date(c, "yyyy-M-d")


def person_name(c: Column) -> Column:
    """White space collapsed, leading titles dropped, each run of letters capitalised."""
    bare = F.regexp_replace(squeeze(c), rf"(?i)^(?:(?:{TITLES})\.?\s+)+", "")
    return F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), F.initcap), "")


def clean_vote(c: Column) -> Column:
    """P25: trimmed, empty as NULL, 50 characters."""
    return F.left(F.nullif(F.trim(c), F.lit("")), F.lit(50))


def vote_bucket(c: Column) -> Column:
    """P26."""
    return F.coalesce(lookup(VOTES, F.lower(F.trim(c))), F.lit("other"))


def quarter_start(year: Column, quarter: Column) -> Column:
    """First day of the quarter; 1 January for an unknown quarter."""
    month = F.when(quarter == "Q2", 4).when(quarter == "Q3", 7).when(quarter == "Q4", 10).otherwise(1)
    return F.make_date(year, month, F.lit(1))


def plain_key(c: Column) -> Column:
    """A department name without case, one leading organisational phrase and punctuation; aliases not resolved."""
    s = F.regexp_replace(F.lower(F.trim(c)), " and ", " & ")
    s = F.regexp_replace(s, r"^(bureau of |department of |office of |the )", "")
    return F.trim(F.regexp_replace(s, r"[^a-z0-9&]+", " "))


def dept_key(c: Column, city: str | None = None) -> Column:
    """Canonical department. With a city, in lower case, its council under both names that it goes by is the city council."""
    key = plain_key(c)
    council = {f"{city} city council": "city council", f"city of {city} city council": "city council"} if city else {}
    return F.coalesce(lookup(ALIASES | council, key), key)


def display_order(name: Column) -> Column:
    """The smallest of these over a group belongs to its label: native variants first, then the longest, then by name."""
    return F.struct(plain_key(name) != dept_key(name), -F.length(name), name)


def norm_title(c: Column) -> Column:
    """P30."""
    return F.lower(squeeze(c))


def norm_party(c: Column) -> Column:
    """Also without corporate suffixes and punctuation."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), rf"[,.]?\s*\b({CORPORATE})\b\.?", " "), r"[^a-z0-9]+", " "))


def goal_status(c: Column) -> Column:
    """None, completed (by substring) or in_progress."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "none").when(F.lower(c).rlike("|".join(COMPLETED)), "completed").otherwise("in_progress")


def resolution_type(title: Column) -> Column:
    """First rule that matches."""
    out = F
    for name, pattern in RESOLUTION_TYPES:
        out = out.when(title.rlike(f"(?i){pattern}"), name)
    return out.otherwise("other")


def grant_status(c: Column) -> Column:
    """P33 for grants."""
    return F.coalesce(lookup(GRANT_STATUS, F.lower(F.trim(c))), F.lit("Active"))


def resolution_status(c: Column) -> Column:
    """P33 for resolutions."""
    s = F.lower(c)
    return F.when(s.rlike("tabl"), "Stalled").when(s.rlike("fail|defeat|reject"), "Closed").when(s.rlike("pass|adopt|approv|ratif"), "Active").otherwise("Proposed")


def period_label(year: Column, quarter: Column) -> Column:
    """P34."""
    return F.trim(F.concat_ws(" ", quarter, year.cast("string")))
