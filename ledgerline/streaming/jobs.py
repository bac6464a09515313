"""Incremental forms (T1 to T3) of three batch jobs, with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ledgerline.functions import text as T
from ledgerline.operators.corpus import chunk_all, chunk_metadata, chunk_sections
from ledgerline.operators.reports import JUDGED, performance, usage_cost
from ledgerline.sources.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["source_file", "elem_idx", "page_number", "element_type", "text"]
ELEMENT = "source_file string, elem_idx int, page_number int, element_type string, text string"
#: Elements that a task hands on, or the state store keeps in a row, at once.
SLICE = 10_000
#: Groups that files are dealt to. A checkpoint holds the files by group, so it goes with this number.
GROUPS = 1024


class WholeFiles(StatefulProcessor):
    """Holds the elements of a file until all have come: those up to the one marked `last`. An unmarked file counts as whole when nothing has come for `idle_ms`.

    Calls are made per group of files, not per file: a batch's files that are whole at once pass through together, and only those that are not
    go to the state store, where each has a row with how many elements have come, of how many, in how many parts, and when it falls due.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("elements", "source_file string, part long", "rows string")
        self.about = handle.getMapState("about", "source_file string", "seen long, total long, parts long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        file, names = pd.factorize(fresh["source_file"], use_na_sentinel=False)
        fresh = fresh.assign(file=file, end=fresh["elem_idx"].where(fresh["last"]))
        per = fresh.groupby("file").agg(n=("file", "size"), end=("end", "max"))
        open_, states = self.open(), {}
        for file, n, end in per.itertuples(name=None):
            source = None if pd.isna(names[file]) else names[file]
            seen, total, parts, _ = open_.get(source, (0, None, 0, None))
            states[file] = source, seen + n, total if pd.isna(end) else int(end) + 1, parts
        done = [f for f, (_, seen, total, _) in states.items() if total is not None and seen >= total]
        now = fresh["file"].isin(done)
        whole = fresh.loc[now, COLUMNS]
        for a in range(0, len(whole), SLICE):
            yield whole.iloc[a : a + SLICE]
        for f in done:
            yield from self.released(states[f][0], states[f][3])
        if len(done) == len(states):
            return
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        for f, some in fresh[~now].groupby("file"):
            source, seen, total, parts = states[f]
            some = some[COLUMNS[1:]].astype(object).where(some[COLUMNS[1:]].notna(), None).to_numpy().tolist()
            for a in range(0, len(some), SLICE):
                self.held.updateValue((source, parts), (json.dumps(some[a : a + SLICE]),))
                parts += 1
            self.about.updateValue((source,), (seen, total, parts, due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for source, (_, _, parts, due) in self.open().items():
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self.released(source, parts)

    def open(self) -> dict[str, tuple]:
        """The state of each file of the group that is not whole."""
        return {k[0]: tuple(v) for k, v in self.about.iterator()} if self.about.exists() else {}

    def released(self, source: str, parts: int) -> Iterator[pd.DataFrame]:
        """What the state store held of a file, which it then forgets."""
        for part in range(parts):
            rows = pd.DataFrame(json.loads(self.held.getValue((source, part))[0]), columns=COLUMNS[1:]).astype({"elem_idx": "Int32", "page_number": "Int32"})
            rows.insert(0, "source_file", source)
            yield rows
            self.held.removeKey((source, part))
        if parts:
            self.about.removeKey((source,))

    def close(self) -> None:
        pass


def chunked(elements: DataFrame, profiles: DataFrame | None, types: DataFrame | None) -> DataFrame:
    """Whole files as classified chunks with their metadata: C1, P11 and P18. Without types every file is cut at sections; without profiles all are unclassified."""
    spark = elements.sparkSession
    if profiles is None:
        profiles = spark.createDataFrame([], "source_file string, document_type string, department string, period string")
    cut = chunk_sections(elements) if types is None else chunk_all(elements, profiles, types)
    ruled = F.coalesce(F.col("element_type").isin("Table", "Title", "Header", "OrgData"), F.lit(False))  # these types go by themselves
    cut = cut.withColumn("ratio", F.when(~ruled, T.numeric_ratio(F.col("text"))))  # looked at several times, made once
    cut = cut.withColumn("content_type", F.coalesce(T.content_rule(F.col("element_type"), F.col("text"), F.col("ratio")), F.lit("narrative"))).drop("ratio")
    return chunk_metadata(cut, profiles)


def stream_new_elements(elements: DataFrame, checkpoint_dir: str, out_dir: str, profiles: DataFrame | None = None, types: DataFrame | None = None, idle_ms: int = 3_600_000, buckets: int = 16) -> StreamingQuery:
    """Elements (source_file, elem_idx, page_number, element_type, text, last) as chunks of whole files in a keyed table, read by new_chunks().

    `last` marks a file's last element. A file may come in any number of batches and in any order: its elements wait in the state store
    until they are whole, or until none has come for idle_ms. Then the file is chunked, classified and tagged, and its chunks replace
    those of an earlier version, in the buckets that its files fall into. A batch that runs again writes the same rows.
    """
    spark = elements.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with timers, batches without data would follow each other for ever
    rows = elements.select("source_file", *(F.col(c).cast("int").alias(c) for c in ("elem_idx", "page_number")), "element_type", "text", F.coalesce("last", F.lit(False)).alias("last"))
    rows = rows.withColumn("dealt", F.pmod(F.xxhash64("source_file"), F.lit(GROUPS)).cast("int"))
    files = rows.groupBy("dealt").transformWithStateInPandas(WholeFiles(idle_ms), ELEMENT, "Append", "ProcessingTime")

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # the table's writes look at the batch more than once
        KeyedTable(batch.sparkSession, out_dir, "source_file", buckets).replace(chunked(batch, profiles, types), batch.select("source_file").distinct())
        batch.unpersist()

    return files.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def new_chunks(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result of T1 so far."""
    return KeyedTable(spark, out_dir, "source_file").read()


class Judgements(StatefulProcessor):
    """The state of a chunk's judgements so far, see reports.judgement_runs: counts, and the least balances from the t-th judgement on."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", ST.StructType([ST.StructField(c, ST.LongType()) for c in ("n", "good", *(f"low{t}" for t in range(1, JUDGED + 1)))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r[["seq", "good"]] for r in rows]).sort_values("seq", kind="stable")["good"].to_numpy(bool)
        n, good, *lows = self.state.get() if self.state.exists() else (0, 0, *[None] * JUDGED)
        balance = 2 * (good + fresh.cumsum()) - (n + pd.RangeIndex(1, len(fresh) + 1).to_numpy())
        for t in range(1, JUDGED + 1):
            part = balance[max(0, t - n - 1) :]
            if len(part):
                lows[t - 1] = int(part.min()) if lows[t - 1] is None else min(lows[t - 1], int(part.min()))
        n, good = n + len(fresh), good + int(fresh.sum())
        self.state.update((n, good, *lows))
        yield pd.DataFrame({"chunk_id": [key[0]], "n": [n], "good": [good], "lows": [lows]})

    def close(self) -> None:
        pass


def stream_chunk_performance(judgements: DataFrame, checkpoint_dir: str, out_dir: str) -> StreamingQuery:
    """Judgements (chunk_id, seq, good) as a log of changed chunks, read by performance_so_far(). A flag once raised stays, also one raised inside a batch.

    Each chunk's state is in the state store, and a batch writes the states of its own chunks alone, to a folder of its own, which a batch that runs
    again replaces. Inside a batch judgements are taken by seq, and batches as they come.
    """
    spark = judgements.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = judgements.schema["chunk_id"].dataType.simpleString()
    states = judgements.select("chunk_id", "seq", "good").groupBy("chunk_id").transformWithStateInPandas(Judgements(), f"chunk_id {kind}, n long, good long, lows array<long>", "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/kind=log/batch={epoch}")

    return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def newest_states(spark: SparkSession, out_dir: str) -> tuple[DataFrame, int]:
    """Of each chunk the newest state, from the newest compaction and the batches after it; and the newest batch."""
    log = spark.read.parquet(out_dir)
    marks = log.agg(F.max(F.when(F.col("kind") == "base", F.col("batch"))).alias("base"), F.max("batch").alias("last")).first()
    rows = log.where(F.col("batch") > F.lit(-1 if marks.base is None else marks.base)).where("kind = 'log'")
    if marks.base is not None:
        rows = rows.unionByName(log.where((F.col("kind") == "base") & (F.col("batch") == F.lit(marks.base))))
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct("n", "good", "lows"), "batch").alias("s")).select("chunk_id", "s.*"), marks.last


def performance_so_far(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result of T2 so far, as M4 shows it."""
    return performance(newest_states(spark, out_dir)[0])


def compact_performance(spark: SparkSession, out_dir: str) -> None:
    """Writes the newest states as a table that readers take instead of the batches up to it; those may then be removed."""
    states, last = newest_states(spark, out_dir)
    states.write.mode("overwrite").parquet(f"{out_dir}/kind=base/batch={last}")


def stream_usage_cost(usage: DataFrame, checkpoint_dir: str, out_dir: str) -> StreamingQuery:
    """Calls and exact cost per call site and day of each batch; usage_by_day() adds them up.

    A batch writes a folder of its own, as in T1. Nothing waits for a day to close and no row is too late, so the result has
    every day at any time; no state is held.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        per = usage_cost(batch).groupBy(F.window("timestamp", "1 day").start.alias("day"), "call_site").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
        per.write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")

    return usage.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def usage_by_day(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result of T3 so far: day, call_site, calls, cost."""
    parts = spark.read.schema("day timestamp, call_site string, calls long, cost decimal(22,6)").parquet(out_dir)
    return parts.groupBy("day", "call_site").agg(F.sum("calls").alias("calls"), F.sum("cost").cast("double").alias("cost"))
