"""Callbacks on records whose effects count once.

A task may run twice, or fail after half of its records. So a callback does not act on the
world itself: it emits texts. Every attempt of a task writes what its records emit to a file
of its own, tasks name their files when they are done, and the run is a manifest of those
names, written last and at once. What a failed or superfluous attempt wrote is in no manifest
and is removed. A run that is already there stays as it is, so repeating it adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.files import delete, files_in, located, read_small, write_once

Callback = Callable[[dict, Callable[[str], None]], None]


@dataclass
class _Written(WriterCommitMessage):
    file: str


class _EffectsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str, callback: Callback) -> None:
        self._folder, self._run, self._callback = folder, run, callback
        self._attempts = f"{folder}/attempts/{run}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """One attempt of a task; where it fails its file is removed."""
        file = f"{self._attempts}/{uuid.uuid4().hex}"
        files, inner = located(file)
        files.create_dir(inner.rsplit("/", 1)[0])
        try:
            with files.open_output_stream(inner) as stream:

                def emit(text: str) -> None:
                    stream.write(json.dumps(text).encode() + b"\n")

                for batch in iterator:
                    for text in batch.column(0):
                        self._callback(json.loads(text.as_py()), emit)
        except BaseException:
            delete(file)
            raise
        return _Written(file)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        kept = {m.file for m in messages if m is not None}
        for file in files_in(self._attempts) if kept else []:
            if f"{self._attempts}/{file.rsplit('/', 1)[1]}" not in kept:
                delete(file)
        if not write_once(f"{self._folder}/runs/{self._run}.json", json.dumps(sorted(kept))):
            delete(self._attempts)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        delete(self._attempts)


def process_each(
    df: DataFrame, callback: Callback, folder: str, run: str, column: str = "data"
) -> bool:
    """Call ``callback(record, emit)`` on every JSON record; False if the run was there.

    What a record emits takes effect with the whole run, or not at all. Anything else the
    callback does may happen more than once. Records are parsed as JSON; null ones and bad
    ones fail the run.
    """
    if read_small(f"{folder}/runs/{run}.json") is not None:
        return False
    name = f"record_effects_{uuid.uuid4().hex}"

    class Effects(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: Any, overwrite: bool) -> _EffectsWriter:
            return _EffectsWriter(folder, run, callback)

    df.sparkSession.dataSource.register(Effects)
    df.select(F.col(column).cast("string").alias("data")).write.format(name).mode("append").save()
    return True


def effects(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """What a run's records emitted, in column ``value``; a run that is not there raises."""
    manifest = read_small(f"{folder}/runs/{run}.json")
    if manifest is None:
        raise ValueError(f"no run {run!r} in {folder}")
    files = json.loads(manifest)
    lines = spark.read.text(files) if files else spark.createDataFrame([], "value string")
    return lines.select(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias("value"))
