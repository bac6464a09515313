"""Quality, cost and operations reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T

#: Price per million tokens: input, output, cache read, cache write. The default serves models not listed.
PRICES = {"model-a": (3.0, 15.0, 0.3, 3.75), "model-b": (1.0, 5.0, 0.1, 1.25)}
DEFAULT = (3.0, 15.0, 0.3, 3.75)
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def usage_cost(usage: DataFrame, prices: dict = PRICES, default: tuple = DEFAULT) -> DataFrame:
    """M1: cost of each call, rounded to 6 digits."""

    def price(i: int) -> Column:
        """In hundredths, so that sums are exact before they are rounded."""
        out = F
        for model, p in prices.items():
            out = out.when(F.col("model") == model, F.lit(round(p[i] * 100)))
        return out.otherwise(F.lit(round(default[i] * 100))) if prices else F.lit(round(default[i] * 100))

    total = sum((F.coalesce(F.col(c), F.lit(0)).cast("long") * price(i) for i, c in enumerate(TOKENS)), F.lit(0))
    return usage.withColumn("cost", (F.bround(total / 100, 0) / 1e6).cast("decimal(12,6)"))


def usage_report(costs: DataFrame, start: str, end: str) -> DataFrame:
    """M2: calls, tokens and cost by call site and model over [start, end); tokens that no call states are NULL, their cost 0."""
    rows = costs.where((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(end).cast("timestamp")))
    sums = [F.sum(c).cast("long").alias(c) for c in TOKENS]
    return rows.groupBy("call_site", "model").agg(F.count("*").alias("calls"), *sums, F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost")).orderBy(F.desc("cost"), "call_site", "model")


def usage_total(costs: DataFrame, start: str, end: str) -> DataFrame:
    """M3: M2's rows summed, per call site and in all, by one rollup."""
    rows = costs.where((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(end).cast("timestamp")))
    return rows.rollup("call_site").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost")).select(F.coalesce("call_site", F.lit("(all)")).alias("call_site"), "calls", "cost")


#: Judgements from which on a chunk has a score.
JUDGED = 5


def judgement_runs(judgements: DataFrame) -> DataFrame:
    """Runs of judgements (chunk_id, seq, good) as states that can be merged in order: chunk_id, run, n, good, lows.

    Over a run, let d be twice the good judgements so far less all so far; a score is too low if d is negative. lows[t - 1] is the least d
    after t or more judgements of the run, for t to JUDGED: what is needed to tell, whatever came before, whether a score was too low
    at a time when the chunk had JUDGED. Runs are ranges of seq, so that a chunk with most rows is spread over tasks.
    """
    parts = int(judgements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = judgements.select("chunk_id", "seq", "good").repartitionByRange(parts, "seq").withColumn("run", F.spark_partition_id())
    so_far = Window.partitionBy("chunk_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k", F.count("*").over(so_far)).withColumn("d", 2 * F.count_if("good").over(so_far) - F.col("k"))
    lows = F.array(*(F.min(F.when(F.col("k") >= t, F.col("d"))) for t in range(1, JUDGED + 1)))
    return rows.groupBy("chunk_id", "run").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), lows.alias("lows"))


def merged_runs(a: Column, b: Column) -> Column:
    """The state of run a followed by run b. Associative."""
    d = 2 * a["good"] - a["n"]
    later = lambda t: d + F.get(b["lows"], F.greatest(F.lit(t) - a["n"], F.lit(1)).cast("int") - 1)
    lows = F.array(*(F.least(F.get(a["lows"], F.lit(t - 1)), later(t)) for t in range(1, JUDGED + 1)))
    return F.struct((a["n"] + b["n"]).alias("n"), (a["good"] + b["good"]).alias("good"), lows.alias("lows"))


def performance(states: DataFrame) -> DataFrame:
    """chunk_id, retrieved, good, bad, flagged, score of states (chunk_id, n, good, lows)."""
    flagged = F.coalesce(F.get("lows", F.lit(JUDGED - 1)) < 0, F.lit(False))
    score = F.when(F.col("n") >= JUDGED, F.bround(F.col("good") / F.col("n") * 5, 2))
    return states.select("chunk_id", F.col("n").alias("retrieved"), "good", (F.col("n") - F.col("good")).alias("bad"), flagged.alias("flagged"), score.alias("score"))


def performance_states(judgements: DataFrame) -> DataFrame:
    """One state per chunk: its runs, which are as many as partitions at most, merged in order."""
    state = "struct<n: bigint, good: bigint, lows: array<bigint>>"
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("good"), F.array(*[F.lit(None)] * JUDGED).alias("lows")).cast(state)
    runs = judgement_runs(judgements).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("run", "n", "good", "lows"))).alias("runs"))
    return runs.select("chunk_id", F.aggregate("runs", none, lambda a, b: merged_runs(a, b).cast(state)).alias("s")).select("chunk_id", "s.*")


def chunk_performance(judgements: DataFrame) -> DataFrame:
    """M4: counts per chunk in order of seq; the flag stays once a running score was below 2.5, from the fifth judgement on."""
    return performance(performance_states(judgements))


def low_scoring(logs: DataFrame, least: float, as_of: str | None = None, months: int = 3) -> DataFrame:
    """M5: logged queries with any score below `least`, newest first. A clock limits queries that are only incomplete to the last months; bad retrieval and wrong answers stay, however old."""
    late = F.col("asked") >= F.add_months(F.lit(as_of).cast("date"), -months) if as_of else F.lit(True)
    rows = logs.where((F.col("retrieval") < least) | (F.col("accuracy") < least) | ((F.col("completeness") < least) & late))
    return rows.orderBy(F.desc("asked"), "query_id")


def failures_by_store(low: DataFrame) -> DataFrame:
    """M6: low-scoring queries by store; `sources` may list several."""
    store = F.coalesce("sources", F.array(F.lit("unknown"))) if "sources" in low.columns else F.array(F.coalesce("store", F.lit("unknown")))
    return low.select(F.explode(store).alias("store")).groupBy("store").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "store")


def eval_score(results: DataFrame, least: float = 3.0) -> DataFrame:
    """M7: mean of the three scores, and whether it passes."""
    mean = (F.col("retrieval") + F.col("accuracy") + F.col("completeness")).cast("double") / 3
    return results.withColumn("mean", F.bround(mean, 4)).withColumn("passed", mean >= least)


def eval_report(results: DataFrame) -> DataFrame:
    """M8: totals, pass rate, averages and the first ten failures with their scores."""
    rows = eval_score(results)
    avg = [F.bround(F.avg(F.col(c).cast("double")), 2).alias(f"avg_{c}") for c in ("retrieval", "accuracy", "completeness")]
    total = rows.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), (F.bround(F.count_if("passed") * 100 / F.count("*")) / 100).alias("pass_rate"), *avg)
    scores = F.concat(F.col("query_id").cast("string"), *(x for c in ("retrieval", "accuracy", "completeness") for x in (F.lit(f" {c[0].upper()}:"), F.col(c).cast("double").cast("string"))))
    worst = rows.where("not passed").orderBy("query_id").limit(10).agg(F.array_sort(F.collect_list(F.struct("query_id", scores.alias("s")))).alias("w"))
    worst = worst.select(F.array_join(F.col("w.s"), ",").alias("first_failures"))
    return total.crossJoin(worst)


def last_run(results: DataFrame) -> DataFrame:
    """M9: the latest (run, date), with its averages."""
    avg = [(F.sum(c).cast("double") / F.count(c)).alias(f"avg_{c}") for c in ("retrieval", "accuracy", "completeness")]
    rows = eval_score(results).groupBy("run_id", F.col("asked").alias("run_date")).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), *avg)
    return rows.orderBy(F.desc("run_date"), F.desc("run_id")).limit(1)


def review_queue(flags: DataFrame) -> DataFrame:
    """Unresolved flags by stage, with the newest of each."""
    return flags.where("not resolved").groupBy("stage").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"), F.max_by("source_file", F.struct("created_at", "id")).alias("newest_file")).orderBy(F.desc("n"), "stage")


def pending_proposals(proposals: DataFrame) -> DataFrame:
    """Newest first."""
    return proposals.where("status = 'pending'").orderBy(F.desc("created_at"), "id")


def stats(documents: DataFrame, logs: DataFrame, performance: DataFrame) -> DataFrame:
    """Three single-row counts side by side."""
    n = lambda d, c, name: d.agg(c.alias(name))
    return n(documents, F.count("*"), "documents").crossJoin(n(logs, F.count("*"), "queries")).crossJoin(n(performance, F.count_if("flagged"), "flagged_chunks"))


def sample_queries(logs: DataFrame, rate: float) -> DataFrame:
    """A fixed share of the queries, the same ones each time; all from a rate of 1 on, none up to 0."""
    drawn = F.conv(F.left(F.md5(F.col("query_id").cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long")
    return logs.where(drawn < int(rate * 16**8))


def vote_counts(votes: DataFrame, resolutions: DataFrame, documents: DataFrame, files: str = "Resolutions%") -> DataFrame:
    """Checks after ingestion as (what, key, n); readers are those of files like `files`, in any case."""
    per = votes.groupBy("resolution_number").agg(F.count("*").alias("n")).select(F.lit("votes").alias("what"), F.coalesce("resolution_number", F.lit("—")).alias("key"), "n")
    amounts = resolutions.agg(F.lit("amounts").alias("what"), F.lit("").alias("key"), F.count("amount").alias("n"))
    readers = documents.where(F.col("source_file").ilike(files)).groupBy("parser_used").agg(F.count("*").alias("n")).select(F.lit("readers").alias("what"), F.col("parser_used").alias("key"), "n")
    return per.unionByName(amounts).unionByName(readers)


def coverage_gap(documents: DataFrame) -> DataFrame:
    """(department, period) pairs without a quarterly report; both lists are distinct values of the registry."""
    rows = documents.where("document_type = 'quarterly_report' and year is not null and quarter <> ''").withColumn("dept_key", T.dept_key("department")).where("dept_key <> ''")
    have = rows.select("dept_key", "year", "quarter").distinct()
    return have.select("dept_key").distinct().crossJoin(have.select("year", "quarter").distinct()).join(have, ["dept_key", "year", "quarter"], "left_anti")


def hard_fact_check(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (source_file, table, n, field, value) beside what was extracted; both long, compared as trimmed text."""
    keys = ["source_file", "table", "n", "field"]
    got = extracted.select(*keys, F.col("value").alias("got"))
    return expected.join(got, keys, "left").withColumn("ok", F.coalesce(F.trim("value") == F.trim("got"), F.lit(False)))


def unpivoted(rows: DataFrame, table: str, fields: list[str]) -> DataFrame:
    """Rows of a typed table as (source_file, table, n, field, value); n counts a file's rows by id from 0."""
    n = F.row_number().over(Window.partitionBy("source_file").orderBy("id")) - 1
    return rows.select("source_file", n.cast("long").alias("n"), *(F.col(f).cast("string") for f in fields)).unpivot(["source_file", "n"], fields, "field", "value").withColumn("table", F.lit(table))
