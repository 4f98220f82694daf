"""Stream reviewed lines into the ledger: an append-only log, settled by replace-by-job when it is read.

Every line names its job and the send it belongs to (a confirm of that job), and
is known by month, job, send and position; a line that names no position is known
by its file and place there, so a file that is read twice gives the same lines.
Hand-typed lines with an id are known by it, those without as others are.
Batches only add to the log, each to folders of its own, so a batch that runs
twice leaves what it left before and no batch touches another's lines. Reading
settles the log: of a month's job the send that arrived last counts, whole, over
however many batches and files it came.

Lines get their ids when they settle: a given id stays with the line that came
first with it, all others are numbered behind the largest. compact() writes the
settled lines, with their ids, as the next snapshot and names the batches that it
holds; a read merges the last snapshot with the batches after it, so its cost
does not grow with the log's age, and ids of a snapshot are final.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.numbering import numbered
from ..schema import WORK_ITEM

LINE = f"{WORK_ITEM}, send string, position long"
LOG = f"{LINE}, origin string, arrived timestamp, batch string"
FIELDS = [c.split()[0] for c in WORK_ITEM.replace("decimal(12,2)", "decimal").split(", ")]
#: What a line is known by, beside its month and job.
KEY = ["send", "position", "origin"]
#: Origin of typed lines that came with an id, which is then their position.
BY_ID = "#id"


def lines(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Work lines as they arrive, a bounded number of files at a time, with their place and the time of their file."""
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files).parquet(path)
    typed = F.col("source_job_id").isNull() & F.col("id").isNotNull()
    return stream.select(
        *FIELDS, F.coalesce("send", F.col("created_at").cast("string"), F.lit("")).alias("send"),
        F.when(typed, F.col("id")).otherwise(F.coalesce("position", F.col("_metadata.row_index"))).alias("position"),
        F.when(typed, BY_ID).when(F.col("position").isNotNull(), "").otherwise(F.col("_metadata.file_name")).alias("origin"),
        F.col("_metadata.file_modification_time").alias("arrived"),
    )


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the lines to the log at path, by month and batch; a batch is named by its query and number."""

    def put(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        rows = batch.withColumn("batch", F.lit(f"{query}-{epoch}"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{path}/log")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(log: DataFrame) -> DataFrame:
    """The lines of a log (LOG, and final for rows of a snapshot) that count: the last send of each (month, job), and each line once."""
    job = ["month", "source_job_id"]
    rows = log.withColumn("__typed", F.when(F.col("origin") == BY_ID, F.col("position")))
    sends = rows.filter("source_job_id IS NOT NULL").groupBy(*job, "send").agg(F.max("arrived").alias("__last"))
    last = sends.groupBy(*job).agg(F.max_by("send", F.struct("__last", "send")).alias("__s")).select(F.col("month").alias("__m"), F.col("source_job_id").alias("__j"), "__s")
    current = F.col("month").eqNullSafe(F.col("__m")) & (F.col("source_job_id") == F.col("__j")) & (F.col("send") == F.col("__s"))
    rows = rows.filter("source_job_id IS NOT NULL").join(last, current, "left_semi").union(rows.filter("source_job_id IS NULL"))
    # A typed line with an id is its newest text, wherever that stands; the id a snapshot gave stays.
    known = [F.when(F.col("__typed").isNull(), F.col(c)).alias(f"__{c}") for c in (*job, *KEY)]
    rows = rows.withColumns({f"__{c}": k for c, k in zip((*job, *KEY), known)})
    newest = F.struct("arrived", "final", "batch")
    pick = F.max_by(F.struct(*(c for c in log.columns if c not in ("id", "final"))), newest).alias("line")
    given = F.min_by("id", F.struct(~F.col("final"), "arrived", "batch")).alias("id")
    return rows.groupBy("__typed", *(f"__{c}" for c in (*job, *KEY))).agg(pick, given, F.max("final").alias("final")).select("id", "final", "line.*")


def settled(log: DataFrame) -> DataFrame:
    """The live lines of a log with an id each."""
    if "final" not in log.columns:
        log = log.withColumn("final", F.lit(False))
    rows = live(log)
    order = ["arrived", "month", "source_job_id", *KEY]
    first = Window.partitionBy("id").orderBy(F.desc("final"), *order)
    named = rows.filter("id IS NOT NULL").withColumn("__first", F.row_number().over(first) == 1)
    kept = named.filter("__first").drop("__first")
    fresh = named.filter("NOT __first").drop("__first").union(rows.filter("id IS NULL"))
    top = kept.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    # Files arrive one after the other, so a file's lines are numbered together and no task numbers all.
    placed = numbered(fresh, "__rank", order, [F.coalesce(F.unix_micros("arrived"), F.lit(-1).cast("long"))])
    fresh = placed.crossJoin(F.broadcast(top)).withColumn("id", (F.col("__top") + F.col("__rank")).cast("long")).drop("__rank", "__top")  # top is one row
    return kept.unionByName(fresh)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots at path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    done = lambda n: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots/{n}/batches/_SUCCESS"))
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and done(n))


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def pending(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot's lines (final) and those of the log's batches that it does not hold."""
    found, log = _versions(spark, path), _log(spark, path)
    none = spark.createDataFrame([], f"{LOG}, final boolean")
    if not found:
        return none if log is None else log.withColumn("final", F.lit(False))
    at = f"{path}/snapshots/version={found[-1]}"
    old = spark.read.schema(f"{LOG}, final boolean").parquet(f"{at}/lines").withColumn("final", F.lit(True))
    if log is None:
        return old
    held = spark.read.schema("batch string").parquet(f"{at}/batches").withColumnRenamed("batch", "__held")
    # Both are names of folders: the join prunes them before files are read.
    return old.unionByName(log.join(held, F.col("batch") == F.col("__held"), "left_anti").withColumn("final", F.lit(False)))


def compact(spark: SparkSession, path: str) -> int:
    """Write the settled lines as the next snapshot, and return its number. One compaction runs at a time.

    A snapshot counts from the moment that its list of batches is finished, which
    is written last; a compaction that dies before leaves a folder that the next
    one overwrites.
    """
    found, log = _versions(spark, path), _log(spark, path)
    version = found[-1] + 1 if found else 1
    at = f"{path}/snapshots/version={version}"
    # What is listed is what is read: a batch that comes meanwhile waits for the next snapshot.
    names = [] if log is None else [r.batch for r in log.select("batch").distinct().collect()]
    batches = spark.createDataFrame([(n,) for n in names], "batch string")
    seen = pending(spark, path)
    settled(seen.filter(F.col("final") | F.col("batch").isin(names))).write.mode("overwrite").parquet(f"{at}/lines")
    batches.coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")
    return version


def ledger(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """The settled lines at path, of one month if given; ids of lines after the last snapshot may still change."""
    rows = settled(pending(spark, path))
    return (rows if month is None else rows.filter(F.col("month") == month)).select(FIELDS)


#: The states of a job that has ended, and seconds that such a job stays in view.
ENDED, KEEP = ("done", "error", "cancelled"), 25


def progress(events: DataFrame, now=None) -> DataFrame:
    """The last state of every job (id, status, message, percent, updated_at) that is open, or ended no more than KEEP seconds before now.

    Without a time, the newest event's counts.
    """
    last = events.groupBy("id").agg(F.max_by(F.struct("status", "message", "percent", "updated_at"), F.struct("updated_at", "status", "message")).alias("x")).select("id", "x.*")
    clock = events.agg(F.max("updated_at").alias("__now")) if now is None else events.sparkSession.range(1).select(F.lit(now).alias("__now"))
    seen = last.crossJoin(F.broadcast(clock))  # one row
    return seen.filter(~F.col("status").isin(*ENDED) | (F.col("__now") - F.col("updated_at") <= F.expr(f"INTERVAL {KEEP} SECONDS"))).drop("__now")


_STATE = "status string, message string, percent int, updated_at timestamp"
_SEEN = f"id string, {_STATE}, gone boolean"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job: keep its last state, tell of each change, and of its end KEEP seconds after."""
    names = [c.split()[0] for c in _STATE.split(", ")]
    if state.hasTimedOut:
        was = state.get
        state.remove()
        yield pd.DataFrame([(key[0], *was, True)], columns=["id", *names, "gone"])
        return
    now = state.get if state.exists else None
    for rows in batches:
        for row in rows.sort_values(["updated_at", "status", "message"])[names].itertuples(index=False):
            if now is None or row.updated_at >= now[3]:
                now = (row.status, row.message, int(row.percent), row.updated_at)
    if now is not None:
        state.update(now)
        if now[0] in ENDED:
            ends = int(pd.Timestamp(now[3]).timestamp() * 1000) + KEEP * 1000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *now, False)], columns=["id", *names, "gone"])


def follow_progress(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Streaming: each change of a job's last state (gone = false), and the end of its time in view (gone = true)."""
    rows = events.withWatermark("updated_at", late).groupBy("id")
    return rows.applyInPandasWithState(_follow, _SEEN, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def job_progress(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Jobs by status and five minutes of event time; closes windows behind the watermark."""
    return events.withWatermark("updated_at", late).groupBy(F.window("updated_at", "5 minutes"), "status").agg(F.count("*").alias("n"))
