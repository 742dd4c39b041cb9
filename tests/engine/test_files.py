import csv
import io
import json
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slatecast.functions.number import three_decimals
from slatecast.operators import markers as m
from slatecast.sources import files, ordered, records


def test_three_decimals_of_a_million_doubles(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 1 << 64, 250_000, dtype=np.uint64).view(np.float64)
    bits = bits[(np.abs(bits) < 2.0**110) | ~np.isfinite(bits)]
    ties = rng.integers(-(10**7), 10**7, 250_000) / 2.0 ** rng.integers(0, 14, 250_000)
    values = np.concatenate([bits, ties, rng.random(250_000), rng.integers(0, 10**6, 150_000) / 1000, np.exp(rng.uniform(-12, 60, 250_000)), np.exp2(np.arange(-60, 110)), [0.0, -0.0, -1e-9, 0.8125, 0.0025, 0.0005, math.inf, -math.inf, math.nan, 2.0**53, 2.0**53 - 1, 4503599627370497.5]])
    want = [f"{x:.3f}" for x in values.tolist()]
    rows = spark.createDataFrame(pd.DataFrame({"x": values, "n": np.arange(len(values))})).select("n", three_decimals(F.col("x")).alias("t"))
    got = rows.toPandas().sort_values("n")["t"].tolist()
    wrong = [(values[k], a, b) for k, (a, b) in enumerate(zip(got, want, strict=True)) if a != b and not math.isnan(values[k])]
    assert len(values) > 10**6 - 10**5 and wrong == []
    assert spark.range(1).select(three_decimals(F.lit(None).cast("double")).alias("t")).first()["t"] is None
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_places():
    assert ordered.places([3, 0, 2, 0], 10, 1) == ([10, 10, 14, 10], 16)
    assert ordered.places([0, 4], 1, 2) == ([1, 1], 5) and ordered.places([], 7, 1) == ([], 7)


def test_one_file_of_many_parts(spark, tmp_path):
    """Empty partitions and separators between parts; the driver sees lengths only."""
    rng = random.Random(3)
    values = {k: rng.choice(["", "x", "é" * 9, "long " * 50]) for k in range(500)}
    rows = spark.createDataFrame(list(values.items()), "k long, value string").where("k < 200 or k > 300").repartitionByRange(23, "k").sortWithinPartitions("k")
    path = ordered.write_ordered(rows, str(tmp_path / "all.txt"), b"<", b">", b"|")
    want = [values[k] for k in range(500) if k < 200 or k > 300]
    # a part that is empty because its first values are gets no separator, as if it had none
    got = open(path, "rb").read().decode()  # noqa: SIM115
    assert got[0] == "<" and got[-1] == ">" and [x for x in got[1:-1].split("|") if x] == [x for x in want if x]
    assert sorted(os.listdir(tmp_path)) == ["all.txt"]
    ordered.write_ordered(rows.limit(0), path, b"<", b">", b"|")
    assert open(path, "rb").read() == b"<>"  # noqa: SIM115


def test_a_failing_task_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "kept.txt"
    path.write_text("before")
    broken = spark.range(1000).repartitionByRange(7, "id").select(F.when(F.col("id") == 700, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="lost"):
        ordered.write_ordered(broken, str(path))
    assert path.read_text() == "before" and os.listdir(tmp_path) == ["kept.txt"]


def test_detections_as_python_writes_them(spark, tmp_path):
    rng = random.Random(4)
    texts = ["plain", 'a "b", c', "灯,光", "", "'", None, " x ", "tab\t"]
    rows = [(k, f"00:00:00:{k % 25:02}", rng.choice(texts), rng.randint(1, 9999), rng.random(), rng.choice(["VFX", "DI"])) for k in range(400)]
    frame = spark.createDataFrame(rows, "frame_number long, timecode string, text string, pixel_count int, confidence double, text_type string")
    path = files.write_detections_csv(frame.orderBy("frame_number"), str(tmp_path / "out.csv"))
    want = io.StringIO(newline="")
    out = csv.writer(want)
    out.writerow(files.HEADER)
    out.writerows((*r[:4], f"{r[4]:.3f}", r[5]) for r in rows)
    assert open(path, encoding="utf-8-sig", newline="").read() == want.getvalue()  # noqa: SIM115
    back = files.read_detections_csv(spark, path).orderBy("line").collect()
    assert [(r["line"], r["frame_number"]) for r in back] == [(k + 1, k) for k in range(400)]


def test_marker_json_as_python_writes_it(spark, tmp_path):
    rows = [("t", float(k), "Green" if k % 3 else "Blue", "n", f'no "{k}" \\ é\n', 1.0, f"c{k}") for k in range(300)]
    marks = spark.createDataFrame(rows, "timeline_id string, frame_id double, color string, name string, note string, duration double, custom_data string").repartition(5)
    for some in (marks, marks.where("frame_id = 7"), marks.limit(0)):
        path = files.write_marker_json(some, str(tmp_path / "m.json"))
        text = open(path, encoding="utf-8").read()  # noqa: SIM115
        listed = json.loads(text)
        assert text == json.dumps(listed, indent=2, ensure_ascii=False)
        assert [x["frame_id"] for x in listed["markers"]] == sorted(r["frame_id"] for r in some.collect())
        assert listed["total_count"] == some.count() and (listed["frame_range"] is None) == (listed["total_count"] == 0)
    assert m.FIELDS[0] == "frame_id"


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records reach over their ends."""
    for name, value in (("spark.sql.files.maxPartitionBytes", "37"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(name, value)
    yield
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def csv_by_one_task(spark, path, header):
    """The fields as Spark reads a file that it does not cut."""
    options = {"header": header, "multiLine": True, "escape": '"', "columnNameOfCorruptRecord": "_bad", "enforceSchema": True}
    return sorted(map(repr, spark.read.schema("c0 string, c1 string, c2 string, _bad string").options(**options).csv(path).select("c0", "c1", "c2").collect()))


def test_csv_in_blocks_as_by_one_task(spark, tmp_path, small_blocks):
    """Quotes that open, close, stand twice or stand alone, line ends within them, CRLF, blank lines and a byte-order mark, at all places of blocks."""
    rng, apart = random.Random(6), 0
    for k in range(24):
        end = rng.choice(["\n", "\r\n"])
        alphabet = ["a", "bc", ",", ",", '"', '"', '""', end, end, " ", "é"] if k % 4 == 3 else ['"x,y"', '"q""r"', f'"l{end}m"', '"', '5" disc', "é", "", f'"{end}"']
        fields = [rng.choice(alphabet) + ("," if rng.random() < 0.7 else end) for _ in range(rng.choice([5, 60, 200]))]
        text = "".join(x.replace('"', "q", 1) if len(x) == 2 else x for x in fields)
        path, header = str(tmp_path / f"{k}.csv"), bool(k % 3)
        with open(path, "w", encoding="utf-8-sig" if k % 4 == 0 else "utf-8", newline="") as file:
            file.write("head,er,x" + end + text)
        with records.same_blocks(spark):
            rows = records.read_records(spark, path, records.Csv(header))
            if rows is None:  # it was told to be of another form
                apart += 1
                continue
            parsed = rows.select(F.from_csv("value", "c0 string, c1 string, c2 string, _bad string", {"escape": '"', "columnNameOfCorruptRecord": "_bad"}).alias("r"))
            got = sorted(map(repr, parsed.select("r.c0", "r.c1", "r.c2").collect()))
        assert got == csv_by_one_task(spark, path, header), text
    assert 0 < apart < 9


def test_json_in_blocks_as_by_one_task(spark, tmp_path, small_blocks):
    """Brackets and quotes in strings, nested values, other arrays, compact and indented files, ends with and without blanks; and files of other forms."""
    rng = random.Random(7)
    texts = ["plain", "}", "{", '"', "\\", '}"{', "[]", ',{"a":1}', '"markers": [', "é", ""]
    kind = "markers array<struct<frame_id:double,color:string,name:string,note:string,duration:double,custom_data:string>>"
    for k in range(16):
        marks = [{"frame_id": float(n), "color": rng.choice(texts), "note": "".join(rng.choices(texts, k=3)), "custom_data": rng.choice([None, "c", {"a": [1, {"b": "}"}]}])} for n in range(rng.choice([0, 1, 12]))]
        whole = {"total_count": len(marks), "colors": {"}": 1}, "others": [{"frame_id": 9.0}], "markers": marks, "more": [{"markers": [{"frame_id": 8.0}]}]}
        text = json.dumps(whole, indent=rng.choice([None, 2]), ensure_ascii=False) + rng.choice(["", "\n", "  "])
        text = {13: text[: len(text) // 2], 14: f"[{text}]", 15: text + "}"}.get(k, text)
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
        want = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("markers").alias("m")).select("m.*")
        got = files.read_marker_json(spark, path).drop("timeline_id")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), text
        assert k > 12 or records.read_records(spark, path, records.JsonArray("markers")) is not None


def test_no_task_reads_a_whole_file(spark, tmp_path, small_blocks):
    """Markers of one file, JSON or CSV, come from many tasks."""
    marks = spark.range(60).selectExpr("'t' timeline_id", "double(id) frame_id", "'Blue' color", "'n' name", "'x' note", "1D duration", "'c' custom_data")
    back = files.read_marker_json(spark, files.write_marker_json(marks, str(tmp_path / "m.json")))
    assert back.count() == 60 and back.select(F.spark_partition_id()).distinct().count() > 20
    with open(tmp_path / "m.csv", "w") as file:
        file.write("frame,tc,note,n,c,kind\n" + "".join(f'{k},t,"a ""note"", or\ntwo",1,0.5,VFX\n' for k in range(60)))
    back = files.read_marker_csv(spark, str(tmp_path / "m.csv"))
    assert [r["note"] for r in back.collect()] == ['a "note", or\ntwo'] * 60 and back.where("ok").select(F.spark_partition_id()).distinct().count() > 3
