"""The same tables kept current by Structured Streaming."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import dedupe_key
from ..operators import scans as S
from ..operators.funnel import current_stage
from ..operators.pages import fingerprint

BUCKETS = 64


# --- a table of which a batch rewrites only the parts it touches ---------------------------
# layout: <path>/version=<batch>/bucket=<hash of the domain>; of each bucket the newest version counts


def _bucket(domain: str = "domain", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(domain), F.lit(buckets)).cast("int")


def _parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """Folders of each bucket as (version, folder), oldest first: file names only."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/bucket=*")
    found: dict[int, list[tuple[int, str]]] = {}
    for status in pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        folder = status.getPath().toString()
        version, bucket = (int(part.split("=")[1]) for part in folder.split("/")[-2:])
        if before is None or version < before:
            found.setdefault(bucket, []).append((version, folder))
    return {bucket: sorted(parts) for bucket, parts in found.items()}


def read_bucketed(spark: SparkSession, path: str, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """The newest version of each bucket (of `only` some), as it was before a batch; null where there is none yet."""
    newest = [parts[-1][1] for bucket, parts in _parts(spark, path, before).items() if only is None or bucket in only]
    return spark.read.parquet(*newest) if newest else None


def update_bucketed(rows: DataFrame, path: str, number: int, update: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Rewrite the buckets that `rows` (domain, …) fall into: `update(before, rows)` gives their new content.

    A replayed batch starts from the same versions and overwrites its own. Versions that no replay needs any more are deleted.
    """
    spark = rows.sparkSession
    touched = {r[0] for r in rows.select(_bucket().alias("b")).distinct().collect()}     # at most BUCKETS numbers
    if not touched:
        return
    after = update(read_bucketed(spark, path, number, touched), rows)
    after.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
    for bucket, parts in _parts(spark, path, number).items():
        for _, folder in parts[:-1] if bucket in touched else ():
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


# --- companies and scans --------------------------------------------------------------------


def stream_company_upsert(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Saves (seq, scanned_at, nested result) kept as a company table (`companies`) and a scan history (`history/batch=N`) under `path`."""
    def save(batch: DataFrame, number: int) -> None:
        rows = S.scan_rows(batch)
        S.append_scan_history(rows).write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        update_bucketed(rows, f"{path}/companies", number, S.upsert_companies)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    return read_bucketed(spark, f"{path}/companies")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/history").drop("batch")


# --- a log of changes: the newest row of a key counts ----------------------------------------
# layout: <path>/batch=<number> for each batch, <path>/merged=<number> for all before that batch


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return {int(s.getPath().getName().split("=")[1]): s.getPath().toString() for s in found}


def read_log(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    """The newest row of each key, of the batches before `before` if it is given; null where there is none yet."""
    folders = [f for kind in ("merged", "batch") for n, f in _folders(spark, path, kind).items() if before is None or n < before or (kind == "merged" and n == before)]
    if not folders:
        return None
    rows = spark.read.parquet(*folders)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("r"))
    return newest.select(key, "r.*")


def append_log(rows: DataFrame, path: str, number: int, key: str, every: int = 64) -> None:
    """Write the rows of a batch; a replayed batch overwrites its own. Every so many batches those before are merged into one folder, so that folders stay few.

    A merge that was cut short is done anew or, once its folder is whole, only tidied up: rows that stand in both folders count once.
    """
    spark = rows.sparkSession
    rows.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    if (number + 1) % every:
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{path}/merged={number}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done) and (held := read_log(spark, path, key, number)) is not None:
        held.write.mode("overwrite").parquet(f"{path}/merged={number}")
    for kind in ("merged", "batch"):
        for n, old in _folders(spark, path, kind).items():
            if n < number:
                fs.delete(hadoop.Path(old), True)


# --- scans: keyed state --------------------------------------------------------------------------

SCAN = ("scanned_at", "id", "it_jobs")
CHANGES = "n_at long, n_id long, n_jobs long, p_at long, p_id long, p_jobs long, alert boolean"
CHANGE = Row("domain", *(c.split()[0] for c in CHANGES.split(", ")))


class NewestTwo(StatefulProcessor):
    """Per domain the newest scan and the one before it, by their own order; a row for each change of these, with an alert once for each rising newest scan."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scans = handle.getValueState("scans", "n_at long, n_id long, n_jobs long, p_at long, p_id long, p_jobs long, a_at long, a_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        old = tuple(self.scans.get() or (None,) * 8)
        known = [t for t in (old[0:3], old[3:6]) if t[0] is not None]
        best = known
        for r in rows:
            best = sorted({*best, (r["at"], r["id"], r["it_jobs"])}, reverse=True)[:2]
        if best != known:
            newest, previous = best[0], best[1] if len(best) > 1 else (None,) * 3
            rising = previous[0] is not None and newest[2] > previous[2]
            alert = rising and newest[:2] != old[6:8]
            self.scans.update((*newest, *previous, *(newest[:2] if alert else old[6:8])))
            yield CHANGE(key[0], *newest, *previous, alert)

    def close(self) -> None:
        pass


def job_changes(stream: DataFrame) -> DataFrame:
    """The change feed of scan history rows (domain, id, scanned_at, it_jobs): a row whenever a domain's newest or previous scan becomes another one.

    The order is that of the scans, not of their arrival: a late scan takes the place it has in the history. A scan given twice counts once; one
    without a count found nothing, one without a time or an id comes before all others, rows without a domain are one domain. The state is in Spark's store, two scans
    a domain, and comes back after a restart.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    low = F.lit(-2**62).cast("long")
    rows = stream.select("domain", F.coalesce(F.unix_micros(F.col("scanned_at").cast("timestamp")), low).alias("at"), F.coalesce(F.col("id").cast("long"), low).alias("id"),
                         F.coalesce(F.col("it_jobs").cast("long"), F.lit(0).cast("long")).alias("it_jobs"))
    return rows.groupBy("domain").transformWithState(NewestTwo(), f"domain {stream.schema['domain'].dataType.simpleString()}, {CHANGES}", "Update", "none")


def stream_jobs_delta(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The change feed kept as a log; `read_jobs_delta` reads the newest two scans of each domain from it, `read_rising_alerts` the alerts."""
    def save(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        alerts = rows.where("alert").select("domain", "n_at", "n_id", "n_jobs", "p_jobs")
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")
        append_log(rows.drop("alert"), f"{path}/scans", number, "domain")
        rows.unpersist()

    return job_changes(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def read_jobs_delta(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Per domain the openings of the newest scan and the change against the one before it."""
    state = read_log(spark, f"{path}/scans", "domain", before)
    return state.select("domain", F.timestamp_micros("n_at").alias("scanned_at"), F.col("n_id").alias("id"), F.col("n_jobs").alias("it_jobs"), F.col("p_jobs").alias("prev_it_jobs"),
                        (F.col("n_jobs") - F.col("p_jobs")).alias("jobs_delta"), F.timestamp_micros("p_at").alias("prev_scanned_at"))


def read_rising_alerts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each newest scan that showed more openings than the one before, in the batch that told so; a replayed batch writes its own alerts again, no others."""
    return spark.read.parquet(f"{path}/alerts").select("batch", "domain", F.timestamp_micros("n_at").alias("scanned_at"), F.col("n_id").alias("id"), F.col("n_jobs").alias("it_jobs"),
                                                       (F.col("n_jobs") - F.col("p_jobs")).alias("jobs_delta"))


# --- stages and pages -------------------------------------------------------------------------


def stream_stage_state(stream: DataFrame) -> DataFrame:
    """Current status and its start per lead (run in update or complete mode)."""
    return current_stage(stream)


def stream_dedupe(stream: DataFrame, delay: str, by: str = "url") -> DataFrame:
    """First page per address (by='url') or per content (by='content') within the event-time delay.

    `stream` needs fetched_at, domain, final_url and text."""
    key = dedupe_key("final_url") if by == "url" else F.coalesce(fingerprint(F.col("text")), dedupe_key("final_url"))
    return (stream.withColumn("_k", key).withWatermark("fetched_at", delay)
            .dropDuplicatesWithinWatermark(["domain", "_k"]).drop("_k"))
