"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

A source's share of the mix is its weight's share of all words, at most CAP times its own words; what is over is shared
among the others by weight. The source's documents, in a fixed pseudo-random order, form a stream that repeats; the mix takes
the stream up to the source's target. Over training time t from 0 to 1 a source is drawn at the rate

    target * (1 + tilt * (2 t - 1)),

whose integral, the cumulative demand target * (t + tilt * (t * t - t)), is inverted to give the time at which each copy of
a document is due. Copies are range-sorted by that time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written

#: Weights of the sources in order of their names, in turn; and tilts of their schedules: below 0 early, above 0 late.
WEIGHTS, TILTS, CAP = (1, 2, 3), (-0.5, 0.0, 0.5), 3
#: Rows of the table for each interval of a source's stream, about; sums go over intervals, then inside each.
INTERVAL = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size) with target and tilt. One row per source, so its windows are over few rows."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("turn", turn)
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("turn") + 1)
    s = s.withColumn("weight", pick(weights)).withColumn("tilt", pick(tilts)).withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # in order of most / weight the capped sources come first; the first that is not capped has the final level
    s = s.withColumn("capped", F.col("most") <= F.col("weight") * F.col("level")).withColumn("k", F.row_number().over(order))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("k"))).over(everything)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", "tilt", target.alias("target"))


def due(u: Column, tilt: Column) -> Column:
    """Time at which the share u of a source's demand has been drawn."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)
    return F.when(u <= 0, 0.0).otherwise(2 * u / (1 - tilt + root))


def mix(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, cap: int = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, source, text) as doc_id, size, source_size, target, taken, copies, positions and, with carry, a struct `carried` of those columns.

    taken is copies times size, copies at most `cap`; positions has the time of each copy. A null text has size 0 and is
    taken as no words, as is an empty one; a long one counts whole. Null is a source of its own, last. Rows of one doc_id are
    ordered by size and are each mixed; equal ones are interchangeable. A source's stream is summed by hash interval first, and
    intervals are the more the more rows there are, so a source with most of them is spread over many tasks. An empty table
    gives an empty result; other columns are ignored, of whatever name.
    """
    digits = max(3, math.ceil(math.log(max(1, docs.count()) / INTERVAL + 1, 16)) + 1)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    group = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("group")  # never null, so that joins and windows agree on it
    columns = [F.col("doc_id").cast("long"), F.col("source").cast("string"), group, word_count(F.col("text").cast("string")).alias("size"), key.alias("key"), F.left(key, F.lit(digits)).alias("part")]
    sized = written(docs.select(*columns), "sizes")
    rows = docs.select(*columns, F.struct(*carry).alias("carried")) if carry else sized
    sums = sized.groupBy("source", "group", "part").agg(F.sum("size").alias("part_size"))
    plan = written(targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, tilts, cap), "targets")
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    sums = sums.join(plan, sums.source.eqNullSafe(plan.source)).select("group", "part", "start", "source_size", "target", "tilt")
    # the join and the window deal rows by the same columns, so rows, which may carry texts, move once
    inside = Window.partitionBy("group", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["group", "part"])
    rows = rows.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2)
    begins = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: p * F.col("source_size") + F.col("at"))
    begins = F.when(F.col("size") > 0, F.filter(begins, lambda x: x < F.col("target"))).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("begins", begins)
    positions = F.transform("begins", lambda x: due(x / F.col("target"), F.col("tilt")))
    copies = F.size("begins").cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), positions.alias("positions"), *(["carried"] if carry else []))


def schedule(docs: DataFrame, **options) -> DataFrame:
    """The copies that the mix takes of docs (doc_id, source, text, ...), with all their columns, in order of their positions."""
    mixed = mix(docs, carry=tuple(docs.columns), **options)
    return mixed.select("doc_id", "carried", F.explode("positions").alias("due")).orderBy("due", "doc_id").select("carried.*")


def op9_source_mixing(spark, sf_dir):
    mixed = mix(table(spark, "documents", sf_dir)).withColumn("position", F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3 AS most,
    (ARRAY[1.0, 2.0, 3.0])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight,
    (ARRAY[-0.5, 0.0, 0.5])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS tilt
  FROM s),
l AS (
  SELECT *, row_number() OVER o AS n,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST)),
t AS (
  SELECT source, source_size, tilt,
    CASE WHEN most <= weight * level THEN most::DOUBLE
      ELSE weight * (SELECT arg_min(level, n) FROM l WHERE most > weight * level) END AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + d.size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size > 0 THEN (mid < target)::INT + (source_size + mid < target)::INT + (2 * source_size + mid < target)::INT ELSE 0 END AS copies,
    mid / target AS u FROM r)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN CASE WHEN u <= 0 THEN 0.0 ELSE 2 * u / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)) END END AS position
FROM c
"""
