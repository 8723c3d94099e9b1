import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinloom.operators import metrics, sizing
from opinloom.operators.ordering import with_scan_ordinal, with_split
from opinloom.session import shared_folder, work_path
from opinloom.sources import delimited, jsonl, tables

LINES = [
    '{"id": "1", "text": "a \\"q\\", b\\nc", "stars": 4.0, "friends": "x"}',
    "",
    '{"id": "2", "stars": 2.5}',
    "   ",
    '{"id": "3", "text": "t", "stars": 1.0, "friends": null, "extra": {"k": 1}}',
]
SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c == "stars" else T.StringType()) for c in ("id", "text", "stars", "friends")]
)


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(LINES), encoding="utf-8")
    return str(path)


def test_jsonl_scan(spark, lines):
    found = sorted(map(tuple, jsonl.scan_jsonl(spark, lines, SCHEMA).collect()))
    assert found == [("1", 'a "q", b\nc', 4.0, "x"), ("2", None, 2.5, None), ("3", "t", 1.0, None)]


def test_jsonl_first_line_keys(spark, lines):
    df = jsonl.scan_jsonl(spark, lines, exclude=("friends",))
    assert df.columns == ["id", "text", "stars"] and df.count() == 3
    assert sorted(r.stars for r in df.collect()) == ["1.0", "2.5", "4.0"]


def test_jsonl_strict(spark, lines, tmp_path):
    with pytest.raises(Exception, match="unexpected keys: extra"):
        jsonl.scan_jsonl(spark, lines, SCHEMA, strict=True).collect()
    wide = T.StructType([*SCHEMA.fields, T.StructField("extra", T.StringType())])
    assert jsonl.scan_jsonl(spark, lines, wide, strict=True).count() == 3
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"id": "1"}\nno json\n')
    with pytest.raises(Exception):
        jsonl.scan_jsonl(spark, str(broken), SCHEMA).collect()


def test_csv_round_trip_and_bom(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, text string, state string")
    rows = [(1, 'say "hi", ok\nnext ', "NA"), (2, None, "AZ"), (3, " lead", "None")]
    path = work_path(spark, "csv")
    delimited.sink_csv(spark.createDataFrame(rows, schema), path)
    assert sorted(map(tuple, delimited.scan_csv(spark, path, schema).collect())) == rows
    missing = delimited.scan_csv(spark, path, schema, na_tokens=True).collect()
    assert sorted((r.id, r.state) for r in missing) == [(1, None), (2, "AZ"), (3, None)]
    bom = tmp_path / "bom.csv"
    bom.write_text('id,text,state\r\n1,"a\nb",x\r\n', encoding="utf-8-sig")
    assert [tuple(r) for r in delimited.scan_csv(spark, str(bom), schema).collect()] == [(1, "a\nb", "x")]


def test_split_sink(spark):
    df = spark.range(10)
    path = work_path(spark, "split")
    tables.sink_split(with_split(df, 0.9, "id"), path)
    assert tables.scan_split(spark, path, "train").count() == 9
    assert [r.id for r in tables.scan_split(spark, path, "test").collect()] == [9]


def test_report_sink(spark):
    df = spark.createDataFrame([(1, 1), (-1, 1)], "a int, p int")
    path = work_path(spark, "report")
    text = tables.sink_report(metrics.confusion(df, "a", "p"), path, "Two rows")
    assert text.startswith("Two rows\nTest rows: 2\nAccuracy: 0.5000")
    assert sorted(r.label for r in spark.read.json(path).collect()) == ["-1", "1", "macro avg", "weighted avg"]


def test_sizes_decide(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    joined = df.join(labels, "doc_id", "left")
    assert sizing.input_bytes(joined) == sizing.input_bytes(df) + sizing.input_bytes(labels)
    unknown = spark.createDataFrame([(1,)], "doc_id int")
    assert sizing.input_bytes(unknown) is None
    assert sizing.fit_partitions(df) == sizing.fit_partitions(unknown) == spark.sparkContext.defaultParallelism
    assert sizing.needed_partitions(df) == 4 == sizing.size_shuffles(df, df)
    monkeypatch.setattr(sizing, "PARTITION_BYTES", 1000)
    assert sizing.cluster_by(df, "doc_id").rdd.getNumPartitions() == sizing.needed_partitions(df) > 4


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    assert shared_folder(spark) == shared_folder(spark)
    settings = {"spark.checkpoint.dir": "hdfs:///shared"}
    monkeypatch.setattr(spark.conf, "get", lambda key, default=None: settings.get(key, default), raising=False)
    assert shared_folder(spark) == "hdfs:///shared"
    assert work_path(spark, "x").startswith("hdfs:///shared/opinloom/x-")


def test_scan_ordinal_over_many_csv_files(spark):
    path = work_path(spark, "csv")
    rows = spark.range(3000).withColumn("text", F.concat(F.lit("line\n"), F.col("id").cast("string")))
    delimited.sink_csv(rows.repartitionByRange(5, "id").sortWithinPartitions("id"), path)
    back = with_scan_ordinal(delimited.scan_csv(spark, path, rows.schema, na_tokens=True))
    assert back.columns == ["id", "text", "ordinal"]
    assert sorted((r.id, r.ordinal) for r in back.collect()) == [(i, i) for i in range(3000)]
    jsonl.sink_jsonl(rows.repartitionByRange(3, "id").sortWithinPartitions("id"), path + "-json")
    lines = with_scan_ordinal(jsonl.scan_jsonl(spark, path + "-json", rows.schema))
    assert lines.where("id != ordinal").count() == 0 and lines.count() == 3000


def test_rejected_lines_keep_file_and_reason(spark, tmp_path):
    good = ['{"a": 1, "b": "x"}', '{"b": "only b"}', '{"a": 2, "more": 5}', '  {"a": null}']
    bad = ['{"a": 1', "[1]", "text", '{"a": "no number"}', '{"a": 1} x']
    (tmp_path / "one.jsonl").write_text("\n".join([*good, "", "  ", *bad]) + "\n")
    (tmp_path / "two.jsonl").write_text("null\n")
    rows, rejects = jsonl.scan_jsonl_with_rejects(spark, str(tmp_path), T.StructType.fromDDL("a int, b string"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, spark.createDataFrame([(1, "x"), (None, "only b"), (2, None), (None, None)], "a int, b string").collect()))
    found = {r.line: (r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect()}
    assert found == {bad[0]: ("one.jsonl", "not JSON"), "[1]": ("one.jsonl", "not an object"), "text": ("one.jsonl", "not an object"),
                     bad[3]: ("one.jsonl", "wrong type"), bad[4]: ("one.jsonl", "not JSON"), "null": ("two.jsonl", "not an object")}
