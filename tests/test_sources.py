import gzip

from conftest import at, values
from pyspark.sql import functions as F

from dueline.sources import tables
from dueline.sources.xes import read_xes

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
  <string key="concept:name" value="a log"/>
  <trace>
    <string key="concept:name" value="c1"/>
    <boolean key="young" value="true"/>
    <event>
      <string key="concept:name" value="begin &amp; end"/>
      <date key="time:timestamp" value="2018-03-01T10:00:00.250+02:00"/>
      <float key="cost" value="2.5"/>
    </event>
    <event>
      <string key="concept:name" value="other"/>
      <date key="time:timestamp" value="2018-03-02T10:00:00Z"/>
      <int key="items" value="3"/>
    </event>
  </trace>
  <trace>
    <string key="concept:name" value="c2"/>
    <event>
      <string key="concept:name" value="begin &amp; end"/>
      <date key="time:timestamp" value="2018-03-03T00:00:00.000"/>
    </event>
  </trace>
</log>
"""


def test_xes(spark, tmp_path):
    plain, packed = tmp_path / "tiny.xes", tmp_path / "tiny.xes.gz"
    plain.write_text(XES)
    packed.write_bytes(gzip.compress(XES.encode()))
    df = read_xes(spark, str(plain))
    names = [
        "case:concept:name", "event_index", "concept:name", "time:timestamp", "cost", "items",
        "case:young",
    ]
    assert sorted(df.columns) == sorted(names)
    # The zone is dropped, the wall clock time stays.
    want = [
        ("c1", 0, "begin & end", at("2018-03-01 10:00:00.25"), 2.5, None, True),
        ("c1", 1, "other", at("2018-03-02 10:00:00"), None, 3, True),
        ("c2", 0, "begin & end", at("2018-03-03"), None, None, None),
    ]
    assert values(df, *names) == want
    assert values(read_xes(spark, str(packed)), *names) == want
    few = read_xes(spark, str(plain), {"concept:name": "string"}, {"cost": "float"})
    assert few.columns == ["event_index", "cost", "case:concept:name"]


def test_csv_keeps_text_and_time(spark, tmp_path):
    rows = [("a;b", at("2024-01-01 10:00:00.123456"), 1.5), (None, at("2024-01-02"), None)]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, v double")
    tables.write_csv(df, str(tmp_path / "log"))
    assert values(tables.read_csv(spark, str(tmp_path / "log"), df.schema)) == values(df)


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).withColumn("year", (F.col("id") % 2 + 2015).cast("int"))

    path = str(tmp_path / "staged")
    first = tables.read_or_build(spark, path, build, ("year",))
    again = tables.read_or_build(spark, path, build, ("year",))
    assert len(calls) == 1 and values(first) == values(again)
    plan = again.filter("year = 2015")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_results_glob(spark, tmp_path):
    for name, h in (("m00_results.csv", 0), ("m01_results.csv", 1), ("m00_other.csv", 9)):
        (tmp_path / name).write_text(f"Classifier;timediff;AUC\nm;{h};0.5\n")
    assert values(tables.read_results(spark, str(tmp_path))) == [("m", 0, 0.5), ("m", 1, 0.5)]
