"""Landed JSON staged, processed, flagged as done and cleaned up.

Everything lives below one working folder: ``staged`` holds the records, ``results``
what the processing gave, ``flags`` the completion flags. Each step starts from what
the one before has written, so losing executors costs no more than one step.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from ..operators.ordering import newest
from ..sources.files import delete
from ..sources.json_records import explode_records, ingest_json, with_record_ids

logger = logging.getLogger(__name__)

Process = Callable[[DataFrame], DataFrame]
_FLAG_SCHEMA = "done boolean, flagged_at timestamp"


def stage_records(records: DataFrame, folder: str) -> None:
    """Write the records with ids; staging them again replaces them."""
    with_record_ids(records).write.mode("overwrite").parquet(f"{folder}/staged")


def process_staged(spark: SparkSession, folder: str, process: Process) -> None:
    """Process the staged records, write the results and set the completion flag."""
    staged = spark.read.parquet(f"{folder}/staged")
    process(staged).write.mode("overwrite").parquet(f"{folder}/results")
    set_flag(spark, folder)


def set_flag(
    spark: SparkSession, folder: str, done: bool = True, batch_id: int | None = None
) -> None:
    """Add a completion flag, of one batch of a stream if its id is given."""
    flag = spark.range(1).select(
        F.lit(done).alias("done"), F.current_timestamp().alias("flagged_at")
    )
    part = "" if batch_id is None else f"/batch_id={batch_id}"
    flag.write.mode("append").parquet(f"{folder}/flags{part}")


def is_done(spark: SparkSession, folder: str) -> bool:
    """The newest completion flag; without any, nothing is done."""
    try:
        flags = spark.read.schema(_FLAG_SCHEMA).parquet(f"{folder}/flags")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    row = newest(flags, "flagged_at").first()
    return bool(row and row["done"])


def clean_up(spark: SparkSession, folder: str) -> bool:
    """Delete staged records and flags if the newest flag says done."""
    if not is_done(spark, folder):
        logger.info("processing not complete, staged records kept")
        return False
    for name in ("staged", "flags"):
        delete(f"{folder}/{name}")
    return True


def run_staging(
    spark: SparkSession,
    landed: str,
    folder: str,
    process: Process,
    lines: bool = True,
) -> bool:
    """Ingest, stage, process, flag and clean up; False if a step failed.

    A failure is logged and ends the run with the staged records still there.
    """
    try:
        stage_records(ingest_json(spark, landed, lines), folder)
        process_staged(spark, folder, process)
        clean_up(spark, folder)
    except Exception:
        logger.exception("staged processing failed")
        return False
    return True


def start_staging_stream(
    spark: SparkSession,
    landed: str,
    folder: str,
    process: Process,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """The same in micro-batches over files as they land, until none are left.

    Spark may run a batch twice after a failure. All output of a batch goes to that
    batch's own partition and replaces what was there, so the outcome counts each record
    once; flags are added, and the newest one of a batch counts. ``process`` gets
    ``batch_id``, ``id`` and ``data``; the first two together are unique over the whole
    stream. What a batch has staged stays until :func:`start_clean_up_stream` sees that
    it is done.
    """
    documents = (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(landed)
    )

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        part = f"batch_id={batch_id}"
        stage = f"{folder}/staged/{part}"
        records = with_record_ids(explode_records(batch), batch_id)
        records.write.mode("overwrite").parquet(stage)
        staged = session.read.parquet(stage)
        process(staged).write.mode("overwrite").parquet(f"{folder}/results/{part}")
        set_flag(session, folder, batch_id=batch_id)

    return (
        documents.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def start_clean_up_stream(spark: SparkSession, folder: str) -> StreamingQuery:
    """Delete what batches have staged once their newest flag says done, until no flag is left.

    The newest flag of each batch is kept as state by its id, so that it counts over all runs
    of this stream: a batch without a flag, or that has been flagged as not done since, keeps
    its stage until a later flag says done. Deleting a stage twice changes nothing.
    """
    flags = spark.readStream.schema(f"{_FLAG_SCHEMA}, batch_id bigint").parquet(f"{folder}/flags")
    newest_flags = flags.groupBy("batch_id").applyInPandasWithState(
        _newest_flag, "batch_id bigint, done boolean", _FLAG_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )

    def delete_stages(changed: DataFrame, _: int) -> None:
        # A trigger has as many rows as batches were flagged since the last one.
        for row in changed.filter("done").select("batch_id").distinct().toLocalIterator():
            delete(f"{folder}/staged/batch_id={row['batch_id']}")

    return (
        newest_flags.writeStream.foreachBatch(delete_stages)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/clean_up_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _newest_flag(
    key: tuple[int], flags: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    done, flagged_at = state.get if state.exists else (False, None)
    for frame in flags:
        # Of flags of the same moment one that says not done counts.
        last = frame.sort_values(["flagged_at", "done"], ascending=[True, False]).iloc[-1]
        if flagged_at is None or last["flagged_at"] > flagged_at:
            done, flagged_at = bool(last["done"]), last["flagged_at"]
        elif last["flagged_at"] == flagged_at:
            done = done and bool(last["done"])
    state.update((done, flagged_at))
    yield pd.DataFrame({"batch_id": [key[0]], "done": [done]})
