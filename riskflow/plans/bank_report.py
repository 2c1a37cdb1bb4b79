"""Account, transaction and merchant report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..operators.joins import join_groups, join_on_keys
from ..sources.tables import read_parquet, write_csv, write_parquet
from ..sources.versions import publish

# What the report's files are called.
PARQUET_NAME, CSV_NAME = "grouped_data.parquet", "grouped_data.csv"


def active_accounts(
    accounts: DataFrame, min_balance: float = 10000, status: str = "Active"
) -> DataFrame:
    """Accounts of one status above a balance."""
    return accounts.filter((F.col("balance") > min_balance) & (F.col("status") == status))


def joined_transactions(
    accounts: DataFrame, transactions: DataFrame, merchants: DataFrame, threshold: float = 500
) -> DataFrame:
    """Transactions with their account and merchant, and the high-value flag."""
    joined = join_on_keys(accounts, transactions, ["account_id"])
    joined = join_on_keys(joined, merchants, ["merchant_id"])
    return joined.withColumn("high_value_transaction", flag(F.col("amount") > threshold))


def bank_report(
    accounts: DataFrame, transactions: DataFrame, merchants: DataFrame, threshold: float = 500
) -> DataFrame:
    """Totals per merchant category and high-value flag.

    Two passes over the transactions, each with small groups: sums per account, category and
    flag, which account for balances and distinct accounts, and the merchants seen per flag.
    So no task holds the pairs of account and merchant, of which there are about as many as
    transactions, and an account or merchant with very many transactions is pre-aggregated
    in every task.
    """
    keys = ["account_id", "merchant_id"]
    flagged = transactions.withColumn("__high", F.coalesce(F.col("amount") > threshold, F.lit(False)))
    categories = merchants.select("merchant_id", "category")
    per_account = (
        join_on_keys(flagged.select(*keys, "__high", "amount", "transaction_id"), categories, ["merchant_id"])
        .groupBy("account_id", "category", "__high")
        .agg(
            F.sum("amount").alias("__amount"),
            F.count("transaction_id").alias("__transactions"),
            F.count(F.lit(1)).alias("__rows"),
        )
    )
    joined = join_on_keys(per_account, accounts.select("account_id", "balance"), ["account_id"])
    balance, rows = F.col("balance"), F.col("__rows").cast("decimal(18,0)")
    weighted = balance * (rows if _is_decimal(accounts, "balance") else F.col("__rows"))
    report = joined.groupBy("category", "__high").agg(
        F.sum("__amount").alias("total_amount"),
        F.sum("__transactions").alias("transaction_count"),
        (
            F.sum(weighted).cast("double")
            / F.sum(F.when(balance.isNotNull(), F.col("__rows")))
        ).alias("avg_balance"),
        F.countDistinct("account_id").alias("unique_accounts"),
    )
    known = join_on_keys(flagged.select(*keys, "__high"), accounts.select("account_id"), ["account_id"], how="left_semi")
    seen = join_on_keys(known.select("merchant_id", "__high").distinct(), categories, ["merchant_id"])
    unique = seen.groupBy("category", "__high").agg(F.countDistinct("merchant_id").alias("unique_merchants"))
    # Both have the same groups: those of transactions whose account and merchant are known.
    report = join_groups(report, unique, ["category", "__high"])
    named = report.withColumn("__high", flag(F.col("__high")))
    return named.withColumnRenamed("__high", "high_value_transaction")


def write_report(report: DataFrame, output_dir: str) -> DataFrame:
    """Write a report as parquet and CSV and give what was written.

    The report is computed once; the CSV is written from the parquet result.
    """
    write_parquet(report, f"{output_dir}/{PARQUET_NAME}")
    written = read_parquet(report.sparkSession, f"{output_dir}/{PARQUET_NAME}")
    write_csv(written, f"{output_dir}/{CSV_NAME}")
    return written


def publish_report(report: DataFrame, output_dir: str) -> DataFrame:
    """Write a report as a new version of parquet and CSV and give what was written.

    Readers of :func:`riskflow.sources.versions.current` find the two of one run, also while
    another one writes or after it failed.
    """
    spark = report.sparkSession

    def as_csv(path: str) -> None:
        # The report is computed once.
        write_csv(read_parquet(spark, path.removesuffix(CSV_NAME) + PARQUET_NAME), path)

    version = publish(output_dir, {PARQUET_NAME: lambda path: write_parquet(report, path), CSV_NAME: as_csv})
    return read_parquet(spark, f"{version}/{PARQUET_NAME}")


def bank_report_files(
    spark: SparkSession, input_dir: str, output_dir: str, threshold: float = 500
) -> DataFrame:
    """Report from the three parquet tables of a folder, written to another one."""
    accounts, transactions, merchants = (
        read_parquet(spark, f"{input_dir}/{name}.parquet")
        for name in ("accounts", "transactions", "merchants")
    )
    return write_report(bank_report(accounts, transactions, merchants, threshold), output_dir)


def _is_decimal(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName().startswith("decimal")
