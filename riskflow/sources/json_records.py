"""JSON records kept as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .json_files import JsonFiles, split_document


@F.pandas_udf(ArrayType(StringType()))
def json_texts(documents: pd.Series) -> pd.Series:
    """Records of JSON documents as texts: those of an array, or the one value.

    Null where a document is not exactly one JSON value, also where something follows it.
    Records keep their text: the order of keys, repeated keys, numbers of any size.
    """
    return documents.map(split_document, na_action="ignore")


def explode_records(documents: DataFrame, strict: bool = True) -> DataFrame:
    """One row ``data`` per record of the documents in column ``value``.

    Documents that are not JSON fail the query, or are left out if not ``strict``
    (:func:`bad_documents` gives them).
    """
    present = _present(documents)
    texts = json_texts(F.col("value"))
    if strict:
        texts = F.coalesce(
            texts, F.raise_error(F.lit("not a JSON document")).cast("array<string>")
        )
    return present.select(F.explode(texts).alias("data"))


def bad_documents(documents: DataFrame) -> DataFrame:
    """The documents that are not JSON."""
    return _present(documents).filter(json_texts(F.col("value")).isNull())


def _present(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("value").rlike(r"\S"))


def read_documents(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Landed JSON as documents in column ``value``.

    With ``lines`` every line is a document and large files are read in parallel;
    without, every file is one document, such as a saved response.
    """
    return spark.read.text(path, wholetext=not lines)


def ingest_json(
    spark: SparkSession, path: str, lines: bool = True, strict: bool = True
) -> DataFrame:
    """Records of landed JSON files, one row of JSON text each.

    With ``lines`` every line is a document. Without, every file is one, which may be an
    array of any length: it is read record by record.
    """
    if not lines:
        spark.dataSource.register(JsonFiles)
        return spark.read.format(JsonFiles.name()).option("strict", str(strict).lower()).load(path)
    return explode_records(read_documents(spark, path, lines), strict)


def with_record_ids(records: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Give records an ``id``, fixed only once the result is written to a table.

    It is unique within one run; of a stream, ``batch_id`` and ``id`` together are.
    """
    batch = [] if batch_id is None else [F.lit(batch_id).cast("bigint").alias("batch_id")]
    return records.select(*batch, F.monotonically_increasing_id().alias("id"), "data")
