"""Workflows in flow order: static thresholds, dynamic thresholds, event table, flags."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskflow.config import Calculation, Dataset, DerivedValues, EventTable, FilterRule, ThresholdValue
from riskflow.plans import bank_report as reports
from riskflow.plans.bank_report import active_accounts, bank_report, bank_report_files, joined_transactions
from riskflow.plans.dynamic_thresholds import dynamic_threshold
from riskflow.plans.event_level import event_level
from riskflow.plans.rule_flags import flagged, with_flag
from riskflow.sources import versions
from riskflow.plans.static_thresholds import (
    attach_static_thresholds,
    nested_thresholds,
    threshold_rows,
    threshold_rows_sql,
    threshold_struct,
    typed_thresholds,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def bank(spark):
    rng = random.Random(3)
    accounts = [(i, float(rng.randrange(20000)), rng.choice(["Active", "Closed"])) for i in range(20)]
    merchants = [(i, rng.choice(["food", "fuel", None])) for i in range(15)]
    # A third of all transactions belong to one account and one merchant.
    transactions = [
        (i, *((0, 0) if i % 3 == 0 else (rng.randrange(25), rng.randrange(18))), float(rng.randrange(1000)))
        for i in range(900)
    ] + [(None, 1, 1, 600.0), (9999, 1, 1, None)]
    return (
        spark.createDataFrame(accounts, "account_id bigint, balance double, status string"),
        spark.createDataFrame(
            transactions, "transaction_id bigint, account_id bigint, merchant_id bigint, amount double"
        ),
        spark.createDataFrame(merchants, "merchant_id bigint, category string"),
    )


def test_bank_report_equals_the_direct_form(spark, bank):
    direct = (
        joined_transactions(*bank)
        .groupBy("category", "high_value_transaction")
        .agg(
            F.sum("amount"), F.count("transaction_id"), F.avg("balance"),
            F.countDistinct("account_id"), F.countDistinct("merchant_id"),
        )
    )
    want = {r[:2]: r[2:] for r in rows(direct)}
    got = {r[:2]: r[2:] for r in rows(bank_report(*bank))}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values)
    default = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        again = {r[:2]: r[2:] for r in rows(bank_report(*bank))}
        assert again == got
    spark.conf.set("spark.sql.shuffle.partitions", default)


def test_bank_report_of_repeated_keys(spark, bank):
    """Rows of accounts and merchants that repeat a key count as often as in the direct form."""
    accounts, transactions, merchants = bank
    accounts = accounts.union(spark.createDataFrame([(0, 7.0, "Active"), (1, None, "Active"), (None, 1.0, "Active")], accounts.schema))
    merchants = merchants.union(spark.createDataFrame([(0, "food"), (0, None), (2, "fuel"), (None, "fuel")], merchants.schema))
    tables = (accounts, transactions, merchants)
    direct = joined_transactions(*tables).groupBy("category", "high_value_transaction").agg(
        F.sum("amount"), F.count("transaction_id"), F.avg("balance"),
        F.countDistinct("account_id"), F.countDistinct("merchant_id"),
    )
    want = {r[:2]: r[2:] for r in rows(direct)}
    got = {r[:2]: r[2:] for r in rows(bank_report(*tables))}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values)


def test_bank_report_groups_no_pairs(bank, capsys):
    """Pairs of account and merchant are about as many as transactions; no task holds them."""
    bank_report(*bank).explain()
    plan = capsys.readouterr().out
    groups = [line for line in plan.splitlines() if "Aggregate(keys=" in line]
    assert groups and not [line for line in groups if "account_id" in line and "merchant_id" in line]


def test_bank_report_files(spark, bank, tmp_path):
    for name, table in zip(("accounts", "transactions", "merchants"), bank):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    report = bank_report_files(spark, str(tmp_path), str(tmp_path / "out"))
    csv = spark.read.option("header", True).schema(report.schema).csv(str(tmp_path / "out/grouped_data.csv"))
    assert rows(csv) == rows(report) and csv.count() == 6


def test_published_reports_come_whole_or_not_at_all(spark, bank, tmp_path, monkeypatch):
    folder = str(tmp_path / "reports")

    def now():
        csv = spark.read.option("header", True).schema(first.schema).csv(versions.current(folder, reports.CSV_NAME))
        return rows(spark.read.parquet(versions.current(folder, reports.PARQUET_NAME))), rows(csv)

    with pytest.raises(FileNotFoundError):
        versions.current(folder, reports.CSV_NAME)
    first = reports.publish_report(bank_report(*bank), folder)
    old = rows(first)
    assert now() == (old, old)

    def fails(df, path):
        raise OSError("disk full")

    other = bank_report(*bank, threshold=1)
    with monkeypatch.context() as patch:
        patch.setattr(reports, "write_csv", fails)
        with pytest.raises(OSError):
            reports.publish_report(other, folder)
    assert now() == (old, old)
    assert len(list((tmp_path / "reports/versions").iterdir())) == 1
    for _ in range(11):
        new = rows(reports.publish_report(other, folder))
    assert now() == (new, new) and new != old
    assert versions.remove_old(folder, keep=2) == 10 and now() == (new, new)
    assert len(list((tmp_path / "reports/versions").iterdir())) == 2
    with pytest.raises(ValueError):
        versions.current(folder, "other.csv")
    with pytest.raises(ValueError):
        versions.remove_old(folder, keep=0)


def test_active_accounts(bank):
    kept = active_accounts(bank[0])
    assert kept.count() == bank[0].filter("balance > 10000 and status = 'Active'").count() > 0


@pytest.fixture(scope="module")
def threshold_tables(spark):
    master = spark.createDataFrame(
        [("sgp", 1, 10), ("sgp", 1, 11), ("sgp", 1, 12), ("hkg", 2, 13)],
        "TSHLD_SET_NAME string, TSHLD_SET_TEMPLATE_ID int, TSHLD_ID int",
    )
    sets = spark.createDataFrame([(1, 100), (2, 200)], "TSHLD_SET_TEMPLATE_ID int, TSHLD_SET_ID int")
    thresholds = spark.createDataFrame(
        [
            (10, 100, "amount", "std_cycles", "3", "integer"),
            (11, 100, "amount", "share", "0.5", "float"),
            (12, 100, "amount", "strict", "True", "boolean"),
            (13, 200, "amount", "std_cycles", "many", "integer"),
            (10, 200, "amount", "std_cycles", "9", "integer"),
            (12, 100, "other", "label", 'a "b"', "text"),
        ],
        "TSHLD_ID int, TSHLD_SET_ID int, TSHLD_TYPE string, TSHLD_NAME string, THSLD_VALUE string, "
        "VALUE_TYPE string",
    )
    return master, sets, thresholds


def test_static_thresholds(spark, threshold_tables):
    by_join = threshold_rows(*threshold_tables)
    assert rows(by_join) == rows(threshold_rows_sql(spark, *threshold_tables))
    assert "10_100" in {r["COMPOSITE_KEY"] for r in by_join.collect()} and by_join.count() == 5
    typed = typed_thresholds(by_join)
    nested = nested_thresholds(typed).select("TSHLD_SET_NAME", F.to_json("thresholds")).collect()
    import json

    assert {r[0]: json.loads(r[1]) for r in nested} == {
        "sgp": {
            "amount": {"std_cycles": 3, "share": 0.5, "strict": True},
            "other": {"label": 'a "b"'},
        },
        "hkg": {"amount": {"std_cycles": "many"}},
    }


def test_last_threshold_wins(spark, threshold_tables):
    later = threshold_rows(*threshold_tables).unionByName(
        threshold_rows(*threshold_tables)
        .filter("TSHLD_ID = 10")
        .withColumns({"TSHLD_ID": F.lit(99), "THSLD_VALUE": F.lit("4")})
    )
    typed = typed_thresholds(later).filter("TSHLD_NAME = 'std_cycles' and TSHLD_SET_NAME = 'sgp'")
    assert typed.first()["value_long"] == 4


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [(1, "a", 50.0), (2, "a", 5.0), (3, "b", 7.0), (4, "z", 1.0), (5, None, 2.0)],
        "event_id int, account_id string, amount double",
    )


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(
        [
            ("a", 10.0, "F", 1), ("a", 14.0, "F", 2), ("a", 99.0, "O", 3), ("b", 4.0, "F", 1),
            ("b", None, "O", 2), (None, 2.0, "F", 1),
        ],
        "account string, value double, status string, seq int",
    )


def calculation(functions=("mean", "std"), filters=(("status", "eq", "F"),), values=(), column="value",
                dataset="history", keys=("account",)):
    return Calculation(
        dataset, keys, DerivedValues(column, functions),
        tuple(FilterRule(*f) for f in filters), tuple(ThresholdValue(*v) for v in values),
    )


def test_rule_from_thresholds_to_flags(spark, threshold_tables, events, history):
    typed = typed_thresholds(threshold_rows(*threshold_tables))
    one_row = threshold_struct(typed, "sgp", "amount", {"std_cycles": "bigint", "strict": "boolean"})
    table = attach_static_thresholds(events, one_row)
    assert table.select("static_thresholds.*").first().asDict() == {"std_cycles": 3, "strict": True}
    calculations = [
        calculation(values=[
            ("upper", "float64", "derived.mean + derived.std * th.std_cycles"), ("fixed", "int32", "7"),
        ]),
        calculation(("count",), (("status", "eq", "O"),), [("twice", "int64", "dth.fixed * 2")]),
        calculation(dataset="nowhere"),
    ]
    with pytest.warns(UserWarning, match="nowhere"):
        result = dynamic_threshold(
            {"e": EventTable(table, ("account_id",))}, {"history": Dataset(history, ("account",))}, calculations
        )["e"]
    assert result.primary_key == ("account_id",)
    out = {r["event_id"]: r for r in result.df.collect()}
    assert out[1]["dynamic_thresholds"]["upper"] == pytest.approx(12 + 3 * 8**0.5)
    assert out[1]["derived_values"].asDict() == {
        "mean": 12.0, "std": pytest.approx(8**0.5), "count": 1,
    }
    # A lone row has no deviation; rows without a match have no values but keep constants.
    assert out[3]["dynamic_thresholds"].asDict() == {"upper": None, "fixed": 7, "twice": 14}
    assert out[3]["derived_values"]["count"] == 0
    assert out[4]["derived_values"].asDict() == {"mean": None, "std": None, "count": None}
    assert out[5]["derived_values"]["mean"] is None and len(out) == 5
    marked = with_flag(result.df, "high", "ev.amount > dth.upper")
    assert {r["event_id"]: r["high"] for r in marked.collect()} == {1: True, 2: False, 3: None, 4: None, 5: None}
    assert [r["event_id"] for r in flagged(marked, "high").collect()] == [1]


def test_existing_structs_are_kept_and_overwritten(spark, events, history):
    table = events.withColumn("derived_values", F.struct(F.lit(1).alias("old"), F.lit(2.0).alias("mean")))
    result = dynamic_threshold(
        {"e": EventTable(table, ("account_id",))},
        {"history": Dataset(history, ("account",))},
        [calculation(("mean",), (), [("sum", "float64", "derived.mean + derived.old")])],
    )["e"].df
    first = result.filter("event_id = 3").first()
    assert first["derived_values"].asDict() == {"old": 1, "mean": 4.0}
    assert first["dynamic_thresholds"]["sum"] == 5.0
    assert result.columns == ["event_id", "account_id", "amount", "derived_values", "dynamic_thresholds"]


def test_ungrouped_calculation_keeps_every_match(spark, events, history):
    result = dynamic_threshold(
        {"e": EventTable(events, ("account_id",))},
        {"history": Dataset(history, ("account",))},
        [calculation((), (), [("double", "float64", "ds.value * 2"), ("own", "str", "derived.value")])],
    )["e"].df
    a = sorted(r["dynamic_thresholds"]["double"] for r in result.filter("event_id = 1").collect())
    assert a == [20.0, 28.0, 198.0]
    assert result.filter("event_id = 4").first()["derived_values"]["value"] is None
    assert result.count() == 3 * 2 + 2 + 1 + 1


def test_ungrouped_calculations_of_one_dataset_share_its_rows(spark, events, history, capsys):
    many = spark.range(30).select(F.lit("k").alias("account"), F.col("id").cast("double").alias("value"))
    event = spark.createDataFrame([(1, "k", 1.0)], "event_id int, account_id string, amount double")
    twice = [
        calculation((), (), [("one", "float64", "ds.value")]), calculation((), (), [("two", "float64", "ds.value")])
    ]
    table = {"e": EventTable(event, ("account_id",))}
    result = dynamic_threshold(table, {"history": Dataset(many, ("account",))}, twice)["e"].df
    got = [r["dynamic_thresholds"] for r in result.collect()]
    assert len(got) == 30 and all(r["one"] == r["two"] for r in got)
    second = [*twice, calculation((), (), [("last", "float64", "ds.value")], dataset="other")]
    other = many.withColumn("seq", -F.col("value"))
    for order, fails in ((("seq",), False), ((), True)):
        datasets = {"history": Dataset(many, ("account",)), "other": Dataset(other, ("account",), order)}
        result = dynamic_threshold(table, datasets, second)["e"].df
        if fails:
            with pytest.raises(PySparkException):
                result.collect()
        else:
            assert {r["dynamic_thresholds"]["last"] for r in result.collect()} == {0.0}
            assert result.count() == 30
            result.explain()
            assert "FullOuter" not in capsys.readouterr().out


def test_first_and_last_follow_the_dataset_order(spark, events, history):
    calculations = [
        calculation(("first", "last"), ()),
        calculation(("max",), (("status", "eq", "F"),)),
        calculation(("median",), (("status", "neq", "O"),)),
    ]
    result = dynamic_threshold(
        {"e": EventTable(events, ("account_id",))},
        {"history": Dataset(history, ("account",), ("seq",))}, calculations,
    )["e"].df
    got = result.filter("event_id = 1").first()["derived_values"].asDict()
    assert got == {"first": 10.0, "last": 99.0, "max": 14.0, "median": 12.0}
    with pytest.raises(ValueError):
        dynamic_threshold(
            {"e": EventTable(events, ("account_id",))}, {"history": Dataset(history, ("account",))}, calculations
        )


@pytest.mark.parametrize("expression", ["derived.nothing", "dth.nothing", "ev.nothing", "ds.nothing", "f(1)"])
def test_bad_threshold_expressions_raise(events, history, expression):
    with pytest.raises(ValueError):
        dynamic_threshold(
            {"e": EventTable(events, ("account_id",))}, {"history": Dataset(history, ("account",))},
            [calculation(values=[("x", "float64", expression)])],
        )


def test_unknown_and_repeated_functions(events, history):
    tables = {name: EventTable(events, ("account_id",)) for name in ("one", "two")}
    with pytest.warns(UserWarning, match="mode"):
        result = dynamic_threshold(
            tables, {"history": Dataset(history, ("account",))}, [calculation(("max", "mode", "max"), ())]
        )
    for table in result.values():
        got = {r["event_id"]: r["derived_values"].asDict() for r in table.df.collect()}
        assert got[1] == {"max": 99.0} and got[4] == {"max": None}


def test_key_lists_must_pair_up(events, history):
    with pytest.raises(ValueError):
        dynamic_threshold(
            {"e": EventTable(events, ("account_id",))}, {"history": Dataset(history, ("account",))},
            [calculation(keys=("account", "status"))],
        )


def test_two_datasets_join_the_events_once(spark, events, history):
    other = history.withColumnRenamed("account", "who")
    result = dynamic_threshold(
        {"e": EventTable(events, ("account_id",))},
        {"history": Dataset(history, ("account",)), "other": Dataset(other, ("who",))},
        [
            calculation(("mean",), (("status", "eq", "F"),)),
            calculation(("sum",), (("value", "gt", "50"),), dataset="other", keys=("who",)),
        ],
    )["e"].df
    got = {r["event_id"]: tuple(r["derived_values"]) for r in result.collect()}
    assert got == {1: (12.0, 99.0), 2: (12.0, 99.0), 3: (4.0, None), 4: (None, None), 5: (None, None)}


def test_event_level(spark, events, history):
    datasets = {
        "events": Dataset(events, ("account_id",)), "history": Dataset(history, ("account",)),
        "again": Dataset(history, ("account",)),
    }
    assert Dataset(events, "account_id").keys == EventTable(events, "account_id").primary_key
    lone = event_level("events:amount", datasets)
    assert lone.columns == ["amount"] and lone.count() == 5
    joined = event_level(["history:value", "events:event_id", "again:value"], datasets)
    assert joined.columns == ["value", "event_id", "value_again"]
    assert joined.count() == 2 * 9 + 4
    with pytest.raises(ValueError):
        event_level(["nowhere:x"], datasets)
    with pytest.raises(PySparkException):
        event_level(["events:no_such_column"], datasets)
