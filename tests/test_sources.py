"""Readers, writers and the staged JSON runs."""

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskflow.session import settings_for, working_folder
from riskflow.sources import json_files, json_records, rules_xml, sql_store, synthetic, tables
from riskflow.streaming import staging

CATALOGUE_HEADER = ["Feature Name", "Category / Feature Group", "Logical Formula (Human-Friendly)"]


def test_header_only_csv(spark, tmp_path):
    path = tmp_path / "catalogue.csv"
    path.write_text(",".join(CATALOGUE_HEADER))
    df = tables.read_csv(spark, str(path), tables.text_schema(CATALOGUE_HEADER))
    assert df.columns == CATALOGUE_HEADER and df.count() == 0


def test_csv_that_does_not_fit_fails(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a\nx\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        tables.read_csv(spark, str(path), "a int").collect()


RULE = """<Rule><DynamicThresholdCalculations>
  <Calculation>
    <DatasetId>ds2</DatasetId>
    <Keys><Key>account_id</Key></Keys>
    <Filters><Filter><Column>amount</Column><Operator>between</Operator><Value>(1, 5)</Value></Filter></Filters>
    <DerivedValues><Column>amount</Column><GroupFunction>mean, std</GroupFunction></DerivedValues>
    <Values>
      <Value name="upper" type="float64">derived.mean + derived.std * th.std_cycles</Value>
      <Value name="lower" type="float64">derived.mean &lt; 5</Value>
    </Values>
  </Calculation>
  <Calculation>
    <DatasetId>ds3</DatasetId>
    <Keys><Key>a</Key><Key>b</Key></Keys>
    <DerivedValues><Column>limit</Column></DerivedValues>
  </Calculation>
</DynamicThresholdCalculations></Rule>"""


def test_rules_are_written_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rules_xml, "RULES_A_FILE", 10)
    rules = spark.range(35).coalesce(1).select(
        F.concat(F.lit("ds"), "id").alias("DatasetId"), F.struct(F.array(F.lit("a <b>")).alias("Key")).alias("Keys")
    )
    rules_xml.write_calculations(rules, str(tmp_path / "rules"))
    files = list((tmp_path / "rules").glob("part-*"))
    assert sorted(file.read_text().count("<Calculation>") for file in files) == [5, 10, 10, 10]
    got = [r[0] for r in rules_xml.read_calculations(spark, str(tmp_path / "rules")).select("DatasetId").collect()]
    assert sorted(got) == sorted(f"ds{i}" for i in range(35))
    assert len(rules_xml.load_calculations(spark, str(tmp_path / "rules"))) == 35


def test_csv_as_other_tools_write_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t,id\n"say ""hi"", now",1\n" s ",2\n"",3\n,4\n"two\nlines",5\n')
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), "id int, t string", line_breaks=True)
    want = [(1, 'say "hi", now'), (2, " s "), (3, ""), (4, None), (5, "two\nlines")]
    assert sorted(tuple(r) for r in got.collect()) == want
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), "id int, other string")
    texts = ["", None, " s ", 'a\\"b', "a\\", '"', "x,y", "l1\nl2", "tab\t", "\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), df.schema, line_breaks=True)
    assert sorted(tuple(r) for r in back.collect()) == list(enumerate(texts))


def test_broken_rules_fail(spark, tmp_path):
    for i, (old, new) in enumerate(
        [("</Column><Operator>", "<Operator>"), ("<Operator>between</Operator>", ""),
         ("<DatasetId>ds3</DatasetId>", ""), ("</Rule>", "")]
    ):
        (tmp_path / f"{i}.xml").write_text(RULE.replace(old, new))
        with pytest.raises((PySparkException, Py4JJavaError, ValueError)):
            rules_xml.load_calculations(spark, str(tmp_path / f"{i}.xml"))


@pytest.mark.parametrize(
    "old, new, named",
    [
        ("between", "betwixt", "betwixt"),
        ("<Key>account_id</Key>", "", "Keys"),
        ("<Keys><Key>a</Key><Key>b</Key></Keys>", "", "Calculation"),
        ('type="float64">derived.mean +', 'type="float65">derived.mean +', "float65"),
        ('name="lower" ', "", "name"),
        ("<DatasetId>ds3</DatasetId>", "<DatasetId> </DatasetId>", "DatasetId"),
        ("<DatasetId>ds3</DatasetId>", "<DatasetId>ds3</DatasetId><Limit>5</Limit>", "Limit"),
    ],
)
def test_rules_that_break_their_schema_fail_in_the_scan(spark, tmp_path, old, new, named):
    assert old in RULE
    (tmp_path / "good.xml").write_text(RULE.replace("between", " BETWEEN ").replace("float64", "Float64"))
    assert rules_xml.read_calculations(spark, str(tmp_path)).count() == 2
    (tmp_path / "broken.xml").write_text(RULE.replace(old, new))
    for read in (rules_xml.read_calculations, rules_xml.load_calculations):
        with pytest.raises((PySparkException, Py4JJavaError)) as failed:
            rows = read(spark, str(tmp_path))
            rows.collect()
        assert "broken.xml" in str(failed.value) and named in str(failed.value)
    assert rules_xml.read_calculations(spark, str(tmp_path), validate=False).count() == 4


@pytest.mark.parametrize("larger", ["a.xml", "b.xml"])
def test_rules_come_by_file_and_place(spark, tmp_path, larger):
    for name in ("a.xml", "b.xml"):
        padding = "<!--" + "x" * 5000 + "-->" if name == larger else ""
        (tmp_path / name).write_text(RULE.replace("ds2", name).replace("<Rule>", "<Rule>" + padding))
    got = [c.dataset_id for c in rules_xml.load_calculations(spark, str(tmp_path))]
    assert got == ["a.xml", "ds3", "b.xml", "ds3"]


def test_load_calculations(spark, tmp_path):
    (tmp_path / "rule.xml").write_text(RULE)
    first, second = rules_xml.load_calculations(spark, str(tmp_path))
    assert (first.dataset_id, first.keys) == ("ds2", ("account_id",))
    assert first.derived.functions == ("mean", "std")
    assert (first.filters[0].operator, first.filters[0].value) == ("between", "(1, 5)")
    assert [v.name for v in first.values] == ["upper", "lower"]
    assert first.values[1].expression == "derived.mean < 5"
    assert second.keys == ("a", "b") and second.derived.functions == () and second.values == ()


def test_parse_rule_text(spark):
    parsed = spark.range(1).select(rules_xml.parse_rule(F.lit(RULE)).alias("r")).first()["r"]
    config = parsed.asDict(recursive=True)
    first, second = rules_xml.calculations(config["DynamicThresholdCalculations"])
    assert first.values[0].type == "float64" and second.dataset_id == "ds3"
    assert rules_xml.retained_columns(config) == []


def test_config_as_plain_mappings():
    config = {
        "Calculation": {
            "DatasetId": "ds2",
            "Keys": {"Key": "account_id"},
            "Filters": {"Filter": {"Column": "status", "Operator": "eq", "Value": "F"}},
            "DerivedValues": {"Column": "amount", "GroupFunction": "mean"},
            "Values": {"Value": {"@name": "upper", "@type": "float64", "#text": "derived.mean"}},
        }
    }
    (only,) = rules_xml.calculations(config)
    assert only.keys == ("account_id",) and only.filters[0].value == "F"
    assert only.values[0].expression == "derived.mean"
    assert rules_xml.calculations({}) == []
    assert rules_xml.retained_columns({"RetainedColumns": {"Column": "ds:x"}}) == ["ds:x"]


def test_json_lines_and_whole_documents(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n\n[{"a": 2}, {"a": {"b": [3]}}]\n')
    got = [r["data"] for r in json_records.ingest_json(spark, str(tmp_path)).collect()]
    assert [json.loads(t) for t in got] == [{"a": 1}, {"a": 2}, {"a": {"b": [3]}}]
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "r.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert json_records.ingest_json(spark, str(whole), lines=False).count() == 2


def test_bad_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(PySparkException):
        json_records.ingest_json(spark, str(tmp_path)).collect()
    assert json_records.ingest_json(spark, str(tmp_path), strict=False).count() == 1
    documents = json_records.read_documents(spark, str(tmp_path))
    assert [r["value"] for r in json_records.bad_documents(documents).collect()] == ["not json"]


def test_json_loses_nothing(spark, tmp_path):
    lines = ['[{"a":1}] {"a":2}', '{"a":1}]garbage', '{"a":1},"x":2', '{"a":1} {"b":2}', '1,"end":1},[2', "[", '{"a":1}\t']
    good = ['[{"a":12345678901234567890.123456789012}]', '["x", null, 5]', "null", "[]"]
    (tmp_path / "x.json").write_text("\n".join(lines + good))
    documents = json_records.read_documents(spark, str(tmp_path))
    assert [r["value"] for r in json_records.bad_documents(documents).collect()] == lines[:-1]
    got = [r["data"] for r in json_records.explode_records(documents, strict=False).collect()]
    assert got == ['{"a":1}', '{"a":12345678901234567890.123456789012}', '"x"', "null", "5", "null"]
    with pytest.raises(PySparkException):
        json_records.explode_records(documents).collect()


def test_records_keep_their_text(spark, tmp_path):
    records = ['{"b":1e400,"a":{"z":-0.0,"y":"\\ud83d"}}', '{"a":1,"a":2}', '"\\u00e9é"', "1E5", "-12", "true", "[ 1 , [] ]", "{}"]
    document = "[" + " ,\t".join(records) + "]"
    (tmp_path / "x.json").write_text("\n".join([document, *records[:6], "[NaN]", "Infinity", "[1,]", "01"]))
    documents = json_records.read_documents(spark, str(tmp_path))
    got = [r["data"] for r in json_records.explode_records(documents, strict=False).collect()]
    assert sorted(got) == sorted(records + records[:6])
    assert json_records.bad_documents(documents).count() == 4
    deep = "[" * 200_000 + "]" * 200_000
    assert json_files.split_document(deep) is None


@settings(max_examples=200, deadline=None)
@given(
    st.recursive(
        st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
        lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=3),
        max_leaves=12,
    ),
    st.integers(1, 9),
    st.booleans(),
)
def test_pieces_of_any_size(value, size, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    got = list(json_files.Scanner(iter(pieces)).records())
    assert got == [json.dumps(v, ensure_ascii=ascii_only) for v in (value if isinstance(value, list) else [value])]
    if text[-1] in '"]}':
        with pytest.raises(ValueError):
            list(json_files.Scanner(iter(pieces[:-1] + [pieces[-1][:-1]])).records())


def test_large_arrays_are_read_in_pieces(spark, tmp_path):
    (tmp_path / "in").mkdir()
    records = [{"i": i, "text": "x" * (i % 300), "é": [i, None]} for i in range(60_000)]
    text = json.dumps(records, indent=1, ensure_ascii=False)
    (tmp_path / "in" / "a.json").write_text(text)
    (tmp_path / "in" / "b.json").write_text('{"i": -1}')
    (tmp_path / "in" / "_done").write_text("not read")
    got = json_records.ingest_json(spark, str(tmp_path / "in"), lines=False)
    assert [json.loads(r["data"]) for r in got.filter("data not like '%-1%'").collect()] == records
    assert got.count() == 60_001
    held = []
    scanner = json_files.Scanner(text[i : i + 10_000] for i in range(0, len(text), 10_000))
    for _ in scanner.records():
        held.append(len(scanner._text))
    assert max(held) < 25_000
    (tmp_path / "in" / "c.json").write_text(text[:-1])
    assert json_records.ingest_json(spark, str(tmp_path / "in"), lines=False, strict=False).count() == 60_001
    with pytest.raises(PySparkException):
        json_records.ingest_json(spark, str(tmp_path / "in"), lines=False).count()
    with pytest.raises(PySparkException):
        json_records.ingest_json(spark, str(tmp_path / "missing"), lines=False).count()


def test_a_record_without_end_is_given_up():
    with pytest.raises(ValueError, match="does not end"):
        list(json_files.Scanner(iter(['["', *["x" * 100] * 50]), longest=1000).records())


def test_query_store(spark, tmp_path):
    (tmp_path / "big.sql").write_text("select id from {t}\nwhere id > 7")
    (tmp_path / "notes.txt").write_text("not a query")
    store = sql_store.load_queries(spark, str(tmp_path))
    assert list(store) == ["big"]
    assert sql_store.run_named(spark, store, "big", {"t": spark.range(10)}).count() == 2
    with pytest.raises(KeyError):
        sql_store.run_named(spark, store, "small", {})
    with pytest.raises(PySparkException):
        sql_store.load_queries(spark, str(tmp_path / "missing"))


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    words, tags = ["a", "b", "c"], ["p", "q", "r", "s", "t", "u"]
    table = synthetic.synthetic_table(spark, 500, words, tags)
    one, many = table.coalesce(1).collect(), table.repartition(9).orderBy("id").collect()
    assert one == many
    assert {r["choice"] for r in one} == set(words)
    assert {len(r["tags"]) for r in one} == set(range(6))
    assert all(len(set(r["tags"])) == len(r["tags"]) for r in one)
    other = synthetic.synthetic_table(spark, 500, words, tags, seed=7).collect()
    assert other != one
    large = spark.range(2**62, 2**62 + 1000)
    picked = synthetic.with_choice(large, "id", "choice", words)
    assert picked.groupBy("choice").count().filter("count > 200").count() == 3


def test_working_folder_is_below_the_shared_folder(spark):
    first, second = working_folder(spark, "x"), working_folder(spark, "x")
    assert first != second
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or first.startswith(shared)


def test_settings_grow_with_the_input():
    small, large = settings_for(10**7, 8), settings_for(10**14, 8000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert small["spark.sql.files.maxPartitionBytes"] == str(128 << 20)
    assert int(large["spark.sql.shuffle.partitions"]) == 10**14 // 2**30
    assert int(large["spark.sql.files.maxPartitionBytes"]) == 10**14 // 200_000


def land(tmp_path, *documents):
    landed = tmp_path / "landed"
    landed.mkdir(exist_ok=True)
    for i, document in enumerate(documents):
        (landed / f"{len(list(landed.iterdir()))}_{i}.json").write_text(document)
    return str(landed)


def take_a(staged):
    return staged.select(F.from_json("data", "a int")["a"].alias("a"))


def test_staging_cleans_up_when_done(spark, tmp_path):
    landed = land(tmp_path, '{"a": 1}\n[{"a": 2}, {"a": 3}]')
    folder = str(tmp_path / "run")
    assert staging.run_staging(spark, landed, folder, take_a)
    assert sorted(r["a"] for r in spark.read.parquet(f"{folder}/results").collect()) == [1, 2, 3]
    assert not (tmp_path / "run/staged").exists() and not (tmp_path / "run/flags").exists()


def test_failed_processing_keeps_the_stage(spark, tmp_path):
    landed = land(tmp_path, '{"a": 1}')
    folder = str(tmp_path / "run")

    def fail(staged):
        return staged.select(F.raise_error(F.lit("no")).alias("a").cast("int"))

    assert not staging.run_staging(spark, landed, folder, fail)
    assert spark.read.parquet(f"{folder}/staged").columns == ["id", "data"]
    assert not staging.is_done(spark, folder) and not staging.clean_up(spark, folder)
    staging.process_staged(spark, folder, take_a)
    assert staging.is_done(spark, folder)
    staging.set_flag(spark, folder, done=False)
    assert not staging.clean_up(spark, folder)
    staging.set_flag(spark, folder)
    assert staging.clean_up(spark, folder)
    assert not (tmp_path / "run/staged").exists()


def test_stream_takes_new_files_once(spark, tmp_path):
    landed = land(tmp_path, '{"a": 1}', '[{"a": 2}]')
    folder = str(tmp_path / "run")
    staging.start_staging_stream(spark, landed, folder, take_a, files_per_batch=1).awaitTermination()
    land(tmp_path, '{"a": 3}')
    staging.start_staging_stream(spark, landed, folder, take_a).awaitTermination()
    results = spark.read.parquet(f"{folder}/results")
    assert sorted(r["a"] for r in results.collect()) == [1, 2, 3]
    assert results.select("batch_id").distinct().count() == 3
    assert spark.read.parquet(f"{folder}/flags").filter("done").count() == 3


def test_stream_goes_on_after_a_failed_batch(spark, tmp_path):
    landed = land(tmp_path, '{"a": 1}', '[{"a": 2}, {"a": 3}]')
    folder = str(tmp_path / "run")
    seen = []

    def fails_once(staged):
        assert staged.columns == ["batch_id", "id", "data"]
        seen.append(staged.count())
        if len(seen) == 2:
            raise RuntimeError("lost")
        return take_a(staged)

    first = staging.start_staging_stream(spark, landed, folder, fails_once, files_per_batch=1)
    with pytest.raises(PySparkException):
        first.awaitTermination()
    assert spark.read.parquet(f"{folder}/flags").count() == 1
    staging.start_staging_stream(spark, landed, folder, fails_once, files_per_batch=1).awaitTermination()
    results = spark.read.parquet(f"{folder}/results")
    assert sorted(r["a"] for r in results.collect()) == [1, 2, 3] and len(seen) == 3


def test_stages_go_when_their_newest_flag_says_done(spark, tmp_path):
    landed = land(tmp_path, '{"a": 1}', '{"a": 2}', '{"a": 3}')
    folder = str(tmp_path / "run")
    batches = []

    def fails_once(staged):
        batches.append(staged.count())
        if len(batches) == 3:
            raise RuntimeError("lost")
        return take_a(staged)

    def staged():
        return sorted(p.name for p in (tmp_path / "run/staged").glob("batch_id=*"))

    def clean_up():
        staging.start_clean_up_stream(spark, folder).awaitTermination()

    with pytest.raises(PySparkException):
        staging.start_staging_stream(spark, landed, folder, fails_once, files_per_batch=1).awaitTermination()
    assert staged() == ["batch_id=0", "batch_id=1", "batch_id=2"]
    # One of the finished ones is called back before the clean-up sees it.
    staging.set_flag(spark, folder, done=False, batch_id=1)
    clean_up()
    assert staged() == ["batch_id=1", "batch_id=2"]
    staging.start_staging_stream(spark, landed, folder, fails_once, files_per_batch=1).awaitTermination()
    assert staged() == ["batch_id=1", "batch_id=2"]
    clean_up()
    assert staged() == ["batch_id=1"]
    staging.set_flag(spark, folder, batch_id=1)
    clean_up()
    assert staged() == []
    results = spark.read.parquet(f"{folder}/results")
    assert sorted(r["a"] for r in results.collect()) == [1, 2, 3]


def test_newest_flag_wins_in_any_order():
    class State:
        def __init__(self):
            self.get, self.exists = None, False

        def update(self, value):
            self.get, self.exists = value, True

    def flags(*rows):
        return pd.DataFrame(rows, columns=["done", "flagged_at"]).assign(flagged_at=lambda f: pd.to_datetime(f["flagged_at"], unit="s"))

    state = State()
    for frames, want in (
        ([flags((True, 5), (False, 2))], True),
        ([flags((False, 3))], True),
        ([flags((False, 5))], False),
        ([flags((True, 9)), flags((False, 8))], True),
    ):
        (out,) = staging._newest_flag((4,), iter(frames), state)
        assert out.to_dict("records") == [{"batch_id": 4, "done": want}]
