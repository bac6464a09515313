"""How queries are registered: a function of conformed tables, and the DuckDB text that states it independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import text
from ledgerline.sources.conform import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as doubles: types that both engines show alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, *views: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(build(Tables(spark, sf_dir)))
    if sql is not None:
        SQL[name] = with_views(sql, *views) if views else sql


# Parts of DuckDB texts.


def pk(x: str) -> str:
    """Plain department key of an expression."""
    return f"trim(regexp_replace(regexp_replace(replace(lower(trim({x})), ' and ', ' & '), '^(bureau of |department of |office of |the )', ''), '[^a-z0-9&]+', ' ', 'g'))"


def dk(x: str) -> str:
    """Canonical department key."""
    return f"CASE {pk(x)} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.ALIASES.items()) + f" ELSE {pk(x)} END"


def label(x: str = "department") -> str:
    """The label of a group."""
    return f"first({x} ORDER BY ({pk(x)} <> {dk(x)}), -length({x}), {x})"


def nt(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


LATEST = "SELECT year, quarter FROM v_expenditures WHERE year IS NOT NULL ORDER BY year DESC, quarter DESC NULLS LAST LIMIT 1"
#: Spending of the latest period without totals.
LINES = f"SELECT e.* FROM v_expenditures e, ({LATEST}) l WHERE e.year = l.year AND e.quarter = l.quarter AND e.line_item NOT ILIKE '%total%'"
ACTIVE = ", ".join(f"'{s}'" for s in text.ACTIVE_GRANT)
SCORES = {c: f"({c} IS NOT NULL)::INT" for c in ("amount", "start_date", "end_date")} | {"status": f"coalesce((lower(trim(status)) IN ({ACTIVE}))::INT, 0)"}


def grants(source: str = "v_grants", scored: tuple[str, ...] = ("amount", "start_date", "end_date", "status"), order: str = "id") -> str:
    """A3 over a table of grants."""
    return f"""(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY title_key, dept_key ORDER BY {" + ".join(SCORES[c] for c in scored)} DESC, {order}) AS k
  FROM (SELECT *, {nt("coalesce(grant_name, '')")} AS title_key, {dk("coalesce(department, '')")} AS dept_key FROM {source})) WHERE k = 1 OR title_key = '')"""
