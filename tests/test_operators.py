"""Table operators on small tables, with skew, nulls and failures."""

import os
import random
import statistics
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskflow.config import Dataset, FilterRule
from riskflow.operators import aggregates, nesting, ordering, record_effects
from riskflow.operators import python_functions as py
from riskflow.operators.aggregates import (
    Aggregate,
    distinct_count,
    get_aggregator,
    group_aggregate,
    group_by_config,
    group_median,
)
from riskflow.operators.columns import rename_by_position, select_qualified
from riskflow.operators.filters import apply_filters
from riskflow.operators.joins import chain_join, join_groups, join_on_keys
from riskflow.operators.ordering import head, newest
from riskflow.session import written


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "a", 5.0, True), (2, "b", 0.0, False), (3, None, None, None), (4, "a.b", -1.5, True)],
        "id bigint, name string, score double, ok boolean",
    ).withColumn("born", F.expr("date'2024-01-01' + cast(id as int)"))


@pytest.mark.parametrize(
    "rule, ids",
    [
        (("score", "eq", 0), [2]),
        (("score", "eq", "0"), [2]),
        (("ok", "eq", False), [2]),
        (("ok", "neq", "true"), [2]),
        (("name", "eq", ""), []),
        (("name", "in", "[a, b]"), [1, 2]),
        (("name", "LIKE", "^a.b$"), [4]),
        (("score", "between", "(-2, 0)"), [2, 4]),
        (("born", "between", "(2024-01-02, 2024-01-03)"), [1, 2]),
        (("born", "gt", "2024-01-04"), [4]),
        (("score", "gt", "2 * 2"), [1]),
        (("id", "lt", "ds.score"), [1]),
        (("id", "in", (1, 4)), [1, 4]),
        (("id", "gte", None), [1, 2, 3, 4]),
        ((None, "eq", 1), [1, 2, 3, 4]),
    ],
)
def test_filters(people, rule, ids):
    kept = apply_filters(people, [FilterRule(*rule)])
    assert [r[0] for r in rows(kept.select("id"))] == ids


@pytest.mark.parametrize(
    "rule",
    [
        ("score", "close to", 5), ("nothing", "eq", 5), ("score", "between", "(1, 2, 3)"),
        ("score", "eq", "abc"), ("ok", "eq", "perhaps"), ("score", "gt", "ds.nothing"),
    ],
)
def test_bad_filters_raise(people, rule):
    with pytest.raises(ValueError):
        apply_filters(people, [FilterRule(*rule)])


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rules = [FilterRule("o_custkey", "between", "(1, 5)"), FilterRule("o_orderstatus", "eq", "F")]
    apply_filters(orders, rules).select("o_orderkey").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(o_custkey,1)" in pushed and "EqualTo(o_orderstatus,F)" in pushed


def test_rename_checks_length(people):
    with pytest.raises(ValueError):
        rename_by_position(people, ["a"])


def test_joins_on_null_keys(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y")], "k int, l string")
    right = spark.createDataFrame([(1, "p"), (None, "q")], "k int, r string")
    assert rows(join_on_keys(left, right, ["k"])) == [(1, "x", "p")]
    assert rows(join_on_keys(left, right, ["k"], how="left")) == [(1, "x", "p"), (None, "y", None)]
    assert rows(join_groups(left, right, ["k"])) == [(1, "x", "p"), (None, "y", "q")]
    with pytest.raises(ValueError):
        join_on_keys(left, right, ["k"], ["k", "r"])
    with pytest.raises(ValueError):
        join_on_keys(left, right.withColumnRenamed("r", "l"), ["k"], ["x"])


def test_chain_join_names(spark):
    frame = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    other = spark.createDataFrame([(1, 11)], "id int, v int")
    third = spark.createDataFrame([(1, 12, 5)], "key int, v int, w int")
    joined = chain_join(
        {"a": Dataset(frame, ("id",)), "b": Dataset(other, ("id",)), "c": Dataset(third, ("key",))}
    )
    assert joined.columns == ["id", "v", "v_b", "v_c", "w"]
    assert rows(joined) == [(1, 10, 11, 12, 5)]
    with pytest.raises(ValueError):
        chain_join({"a": Dataset(frame, ("id",)), "b": Dataset(other, ("id", "v"))})
    with pytest.raises(ValueError):
        chain_join({})


def test_select_qualified_rejects_bad_names(people):
    with pytest.raises(ValueError):
        select_qualified(people.alias("p"), ["p.id"])
    with pytest.raises(ValueError):
        select_qualified(people.alias("p"), ["p:id", "p:id", "p:id"])


def test_aggregates_by_name(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 5.0, 3)], "k string, v double, t int")
    grouped = df.groupBy("k").agg(get_aggregator("v", "Mean"), get_aggregator("v", "std", "sd"))
    assert grouped.columns == ["k", "Mean_v", "sd"]
    assert rows(grouped) == [("a", 2.0, pytest.approx(2**0.5)), ("b", 5.0, None)]
    with pytest.warns(UserWarning):
        assert get_aggregator("v", "mode") is None
    with pytest.raises(ValueError):
        get_aggregator("v", "first")


def test_aggregates_of_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    double = F.col("v") * 2
    wanted = [Aggregate(double, "median", "m"), Aggregate(double + 1, "max", "x"), Aggregate(double, "sum", "s")]
    assert rows(group_aggregate(df, ["k"], wanted)) == [("a", 4.0, 7.0, 8.0), ("b", 10.0, 11.0, 10.0)]


def test_group_by_config_forms(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 5.0, 3)], "k string, v double, t int")
    assert group_by_config(df, "k", "v", functions="mean").columns == ["k", "mean"]
    assert group_by_config(df, ["k"], "v", functions="min, median").columns == ["k", "v_min", "v_median"]
    both = group_by_config(df, "k", "v", ["v", "t"], ["last", "max"], order_by=["t"])
    assert rows(both) == [("a", 3.0, 2), ("b", 5.0, 3)]
    with pytest.raises(ValueError):
        group_by_config(df, "k", "v")
    with pytest.raises(ValueError):
        group_by_config(df, "k", "v", ["v", "t"], "min, max, sum")
    with pytest.warns(UserWarning):
        assert group_by_config(df, "k", "v", functions="min, mode").columns == ["k", "v_min"]


def test_median_of_any_values(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    data = [("hot", float(rng.choice([1, 1, 1, 2, rng.gauss(0, 1e6)]))) for _ in range(1001)]
    data += [("even", float(i)) for i in range(100)] + [("same", 7.0)] * 60 + [("huge", 1.6e308)] * 6
    data += [("small", 1.0), ("small", 4.0), (None, 2.0)] + [(None, None)] * 40 + [("empty", None)]
    data += [("wide", v) for v in (1e300, -1e300, 0.0, 1e-300) for _ in range(20)]
    data += [("tail", rng.lognormvariate(-20, 4)) for _ in range(20_001)]
    data += [("inf", v) for v in (inf, inf, inf, 1.0, -inf)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    want = {}
    for key, value in data:
        if value is not None:
            want.setdefault(key, []).append(value)
    want = {key: inf if key == "inf" else statistics.median(v) for key, v in want.items()} | {"huge": 1.6e308}
    got = {r["k"]: r["m"] for r in group_median(df, ["k"], "v", "m").collect()}
    assert got == pytest.approx(want, rel=1e-12, abs=0)
    mixed = spark.createDataFrame([("a", nan), ("a", nan), ("a", 1.0), ("b", nan), ("b", 1.0), ("b", 2.0)], df.schema)
    got = {r["k"]: r["m"] for r in group_median(mixed, ["k"], "v", "m").collect()}
    assert got["b"] == 2.0 and got["a"] != got["a"]
    everything = group_aggregate(df, ["k"], [Aggregate("v", "median", "m"), Aggregate("v", "count", "n")])
    assert everything.columns == ["k", "m", "n"]
    by_key = {r["k"]: (r["m"], r["n"]) for r in everything.collect()}
    assert by_key["empty"] == (None, 0) and by_key["even"] == (49.5, 100) and by_key[None] == (2.0, 1)
    with pytest.raises(ValueError):
        group_median(df, ["v"], "k", "m")


def test_few_values_of_a_large_group_are_put_in_order(spark):
    values = F.exp(F.randn(3) * 4 - 20)
    df = spark.range(400_000, numPartitions=8).select(F.lit(1).alias("k"), values.alias("v"))
    result = group_median(df, ["k"], "v", "m")
    want = df.agg(F.median("v")).first()[0]
    assert result.first()["m"] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("margin", [aggregates.MARGIN, 1e-7])
def test_medians_of_large_groups_of_several_columns(spark, monkeypatch, margin):
    """Also where sketches miss the middle, as all do with a margin that small."""
    monkeypatch.setattr(aggregates, "MARGIN", margin)
    nan = F.lit(float("nan"))
    df = spark.range(60_000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 4000 > 0, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.when(F.col("id") % 11 > 0, F.exp(F.randn(7) * 3)).alias("a"),
        F.floor(F.rand(8) * 5).cast("int").alias("b"),
        F.when(F.col("id") % 9 > 0, F.randn(9)).otherwise(nan).alias("c"),
        F.when(F.col("id") % 2 > 0, nan).otherwise(F.randn(9)).alias("d"),
    )
    names = ["a", "b", "c", "d"]
    got = aggregates.group_medians(df, ["k"], {f"m{c}": c for c in names})
    want = df.groupBy("k").agg(*[F.median(c).cast("double").alias(f"m{c}") for c in names])
    assert got.columns == want.columns
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


@pytest.mark.parametrize("size", [1, 2, 4095, 4096, 4097, 8191])
def test_median_around_the_size_of_a_sketch(spark, size):
    df = spark.range(size, numPartitions=5).select(F.lit(None).cast("int").alias("k"), F.hash("id").alias("v"))
    assert group_median(df, ["k"], "v", "m").first()["m"] == df.agg(F.median("v")).first()[0]


def test_distinct_count_ignores_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None)], "k string, v int")
    assert rows(distinct_count(df, ["k"], "v", "n")) == [("a", 1), ("b", 0)]


def test_collect_rows_in_chunks_of_the_caller(spark):
    data = [("hot", i) for i in range(1000)] + [("hot", 5)] * 500 + [("cold", 1), (None, 2)]
    df = spark.createDataFrame(data, "k string, v int")
    lists = nesting.collect_rows(df, ["k"], ["v"], F.col("v") % 30)
    sizes = {(r["k"], r["chunk"]): len(r["rows"]) for r in lists.collect()}
    assert max(sizes.values()) == 34 and len([k for k, _ in sizes if k == "hot"]) == 30
    want = rows(df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("copies")))
    assert rows(nesting.unnest_rows(lists, ["k"], ["v"])) == want
    whole = nesting.collect_rows(df, ["k"], ["v"], F.lit(0))
    assert whole.count() == 3 and rows(nesting.unnest_rows(whole, ["k"], ["v"])) == want


def test_running_sums_in_ranges_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    data = [("hot", i, rng.choice([None, 1, 5])) for i in range(5000)] + [(None, i, i) for i in range(7)]
    data += [(f"k{i % 50}", i, 2) for i in range(400)] + [("hot", None, 9), ("k1", None, 4)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, t int, v int")
    own = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "t", "v", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(a) for c, a in ((F.lit(1), "rank"), (F.col("v"), "sum"))])
    sums = {"rank": F.lit(1), "sum": "v"}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cuts = []
    monkeypatch.setattr(ordering, "written", lambda frame, name: cuts.append(written(frame, name)) or cuts[-1])
    try:
        assert rows(ordering.running_sums(df, ["k"], ["t"], sums).select(want.columns)) == rows(want)
        # No range has all rows of the large key.
        assert cuts[0].filter("k = 'hot'").select("__block").distinct().count() > 1
        assert rows(ordering.running_sums(df, ["k"], ["t"], sums, split_by=[F.floor(F.col("t") / 9)]).select(want.columns)) == rows(want)
        block = F.coalesce(F.floor(F.col("t") / 64), F.lit(-1))
        assert rows(ordering.running_sums(df, ["k"], ["t"], sums, block=block).select(want.columns)) == rows(want)
        assert len(cuts) == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lists_of_one_key_are_bounded(spark):
    df = spark.range(1_000_000, numPartitions=8).select(
        F.when(F.col("id") > 5, "hot").alias("k"), (F.col("id") * 7919 % 400_000).alias("v")
    )
    lists = nesting.collect_ranked(df, ["k"], ["v"], size=1000).cache()
    sizes = [(r["k"], r["part"], r["n"]) for r in lists.select("k", "part", F.size("rows").alias("n")).collect()]
    assert sorted(s for s in sizes if s[0]) == [("hot", i, 1000) for i in range(400)]
    assert [s for s in sizes if not s[0]] == [(None, 0, 6)]
    again = nesting.unnest_rows(lists, ["k"], ["v"])
    want = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("copies"))
    assert again.exceptAll(want).isEmpty() and again.count() == want.count()
    ends = lists.filter("k = 'hot'").select("part", F.col("rows")[0]["v"].alias("first"), F.element_at("rows", -1)["v"].alias("last"))
    assert sorted(map(tuple, ends.collect())) == [(i, 1000 * i, 1000 * i + 999) for i in range(400)]
    lists.unpersist()


def test_features_by_date_last_one_wins(spark):
    df = spark.createDataFrame(
        [("x", "2024-01-02", 1, 1.0), ("x", "2024-01-02", 2, None), ("x", "2024-01-01", 1, 3.0)],
        "account string, day string, seq int, f double",
    ).withColumn("day", F.col("day").cast("date"))
    nested = nesting.nested_json(df, "account", "day", ["f"], ["seq"]).collect()
    assert [tuple(r) for r in nested] == [
        ("x", '{"x":{"2024-01-01":{"f":3.0},"2024-01-02":{"f":null}}}')
    ]
    with pytest.raises(ValueError):
        nesting.features_by_date(df.withColumn("day", F.lit("x")), "account", "day", ["f"], ["seq"])


def test_head_and_newest(spark):
    df = spark.range(20)
    assert rows(head(df, 3, [F.col("id").desc()])) == [(17,), (18,), (19,)]
    assert head(df).count() == 5
    assert rows(newest(df, "id")) == [(19,)]


def test_combine_groups_any_split(spark):
    import pandas as pd

    def partial(frame):
        return pd.DataFrame({"total": [int(frame["v"].sum())]})

    def merge(frame):
        return pd.DataFrame({"total": [int(frame["total"].sum())]})

    def sums(column):
        return lambda frame: frame.groupby("k", dropna=False, as_index=False).agg(total=(column, "sum"))

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
                                  F.col("id").alias("v"))
    want = rows(df.groupBy("k").agg(F.sum("v")))
    schema = "k bigint, total bigint"
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for partitions, size, held in ((1, 50, 100_000), (7, 50, 4), (50, 10_000, 30), (7, 50, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        split = df.repartition(partitions)
        for functions in ((sums("v"), sums("total")), (py.each_key(["k"], partial), py.each_key(["k"], merge))):
            assert rows(py.combine_groups(split, ["k"], *functions, schema, held_rows=held)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_combine_groups_keeps_keys_apart(spark):
    import pandas as pd

    nan, big = float("nan"), 2**53
    data = [(big + 1, None, 0.0, 1), (big + 1, None, -0.0, 1), (None, "a", nan, 1), (big, "", None, 1), (big, None, None, 1)]
    data += [(None, "a", nan, big + 1), (None, None, 1.5, None), (big, "", None, big)]
    df = spark.createDataFrame(data, "i long, s string, f double, v long").repartition(3)
    keys = ["i", "s", "f"]

    def sums(frame):
        return frame.groupby(keys, dropna=False, as_index=False).agg({"v": "sum"})

    one = py.each_key(keys, lambda frame: pd.DataFrame({"v": [frame["v"].sum()]}))
    want = rows(df.groupBy(*keys).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")))
    for function in (sums, one):
        for held in (1, 2, 1000):
            got = py.combine_groups(df, keys, function, function, "i long, s string, f double, v long", held_rows=held)
            assert list(map(str, rows(got))) == list(map(str, want))
    assert len(want) == 5
    assert rows(py.combine_groups(df.limit(0), keys, sums, sums, "i long, s string, f double, v long")) == []


def test_combine_groups_finds_changed_keys(spark):
    df = spark.createDataFrame([(2**53 + 1, 1), (None, 2)], "k long, v long").coalesce(1)

    def through_floats(frame):
        return frame.assign(k=frame["k"].astype("float64"))

    with pytest.raises(PySparkException, match="changed values of key"):
        py.combine_groups(df, ["k"], through_floats, through_floats, "k long, v long").collect()
    with pytest.raises(ValueError):
        py.combine_groups(df, ["k"], through_floats, through_floats, "v long")


def test_process_records_bad_json_fails(spark):
    df = spark.createDataFrame([("{",)], "data string")
    with pytest.raises(PySparkException):
        py.process_records(df, lambda r: r, "a int").collect()


def test_effects_of_a_run_count_once(spark, tmp_path):
    folder = str(tmp_path / "effects")
    df = spark.range(100, numPartitions=4).select(F.to_json(F.struct("id")).alias("data"))

    def fails(record, emit):
        emit(f"seen {record['id']}")
        if record["id"] == 77:
            raise RuntimeError("lost")

    def works(record, emit):
        for _ in range(record["id"] % 3):
            emit(f'{record["id"]}\n"é"')

    with pytest.raises(PySparkException):
        record_effects.process_each(df, fails, folder, "day 1")
    with pytest.raises(ValueError):
        record_effects.effects(spark, folder, "day 1")
    assert not list((tmp_path / "effects" / "attempts").glob("*/*"))
    assert record_effects.process_each(df, works, folder, "day 1")
    assert not record_effects.process_each(df, fails, folder, "day 1")
    want = sorted(f'{i}\n"é"' for i in range(100) for _ in range(i % 3))
    assert sorted(r["value"] for r in record_effects.effects(spark, folder, "day 1").collect()) == want
    assert record_effects.process_each(df.limit(0), works, folder, "day 2")
    assert record_effects.effects(spark, folder, "day 2").count() == 0


RETRIED = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from riskflow.operators.record_effects import effects, process_each
folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.range(40, numPartitions=2).select(F.to_json(F.struct("id")).alias("data"))

def fails_once(record, emit):
    emit(str(record["id"]))
    marker = Path(folder, "failed")
    if record["id"] == 33 and not marker.exists():
        marker.touch()
        raise RuntimeError("lost")

process_each(df, fails_once, folder, "r")
assert Path(folder, "failed").exists()
assert sorted(int(r["value"]) for r in effects(spark, folder, "r").collect()) == list(range(40))
assert len(list(Path(folder, "attempts").glob("*/*"))) == 2
"""


def test_effects_of_a_task_that_runs_twice(tmp_path):
    # Tasks are tried again only in a session made for it.
    root = str(Path(__file__).parents[1])
    ran = subprocess.run(
        [sys.executable, "-c", RETRIED, str(tmp_path)],
        env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300,
    )
    assert ran.returncode == 0, ran.stderr[-2000:]


def test_cap_partitions(spark):
    assert py.cap_partitions(spark.range(100, numPartitions=50), 4).rdd.getNumPartitions() == 4
    assert py.cap_partitions(spark.range(100, numPartitions=50), 4).count() == 100
    assert py.cap_partitions(spark.range(100, numPartitions=4), 32).rdd.getNumPartitions() == 4
    assert py.cap_partitions(spark.range(100, numPartitions=4), 32, shuffle=True).rdd.getNumPartitions() == 32
