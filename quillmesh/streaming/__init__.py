"""Streaming forms of the stateless pipeline and of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.sinks import TERMINAL
from quillmesh.plans.pipeline import Engine


def results_stream(sources: DataFrame, engine: Engine | None = None) -> DataFrame:
    """The same plan on a stream of sources; all steps are stateless."""
    return (engine or Engine()).run(sources)


def once(events: DataFrame, ts: str = "arrived_at", key: str = "log_id", late: str = "30 days") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def final_states(events: DataFrame, key: str = "source_id", event: str = "event", ts: str = "ts", late: str = "30 days") -> DataFrame:
    """Last terminal event of each key per day of event time; use update or append mode."""
    last = F.max(F.when(F.col(event).isin(*TERMINAL), F.struct(F.col(ts).alias("t"), F.col(event).alias("e"))))
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), key).agg(last["e"].alias("final_event"), F.count("*").alias("n_events"))


def talk_sessions(cues: DataFrame, key: str = "extraction_id", at: str = "at", gap: str = "1500 milliseconds", late: str = "1 day") -> DataFrame:
    """Cues of a key joined while the pause stays within the gap."""
    return cues.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n_cues"))


def upsert(target: str, key: str = "source_id"):
    """A foreachBatch function that writes each batch to a folder of its own, once per key; a batch that is repeated replaces itself.

    ``current`` reads the table that results: of a key in several batches the latest row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def current(spark: SparkSession, target: str, key: str = "source_id") -> DataFrame:
    """The rows of a folder that ``upsert`` writes, the latest one of each key. Rows are combined before they travel."""
    every = spark.read.parquet(target)
    row = F.struct(*[c for c in every.columns if c != "batch_id"])
    return every.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, "batch_id").alias("r")).select("r.*")
