"""Documents of any number of rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodegrain.operators import symbols
from lodegrain.plans import scan
from lodegrain.sources.files import as_files
from lodegrain.sources.report import ROWS, write_document


def test_documents_hold_all_rows_and_the_envelope(spark, tmp_path):
    path = str(tmp_path / "d.json")
    rows = spark.range(20_000).repartition(7).select(F.to_json(F.struct("id", F.lit('a "b"\n\u00e9').alias("t"))).alias("value"))
    write_document(rows, path, {"a": 1, "list": ROWS, "z": "é"})
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    assert list(got) == ["a", "list", "z"] and sorted(x["id"] for x in got["list"]) == list(range(20_000)) and got["list"][0]["t"] == 'a "b"\né'
    assert os.listdir(tmp_path) == ["d.json"]


def test_empty_null_and_refused_documents(spark, tmp_path):
    path = str(tmp_path / "d.json")
    write_document(spark.createDataFrame([(None,)], "value string"), path, {"r": [ROWS]})
    assert json.load(open(path)) == {"r": [[]]}
    with pytest.raises(Exception, match="FileExists|exists"):
        write_document(spark.createDataFrame([("1",)], "value string"), path, {"r": ROWS}, overwrite=False)
    with pytest.raises(ValueError, match="once"):
        write_document(spark.createDataFrame([("1",)], "value string"), path, {"r": 1})
    with pytest.raises(Exception, match="boom"):
        write_document(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.lit("1")).cast("string").alias("value")), path, {"r": ROWS})
    assert json.load(open(path)) == {"r": [[]]} and os.listdir(tmp_path) == ["d.json"]


def test_reports_of_an_analysis(spark, tmp_path):
    files = as_files(spark.createDataFrame([("a.py", "def used(): pass\ndef lost(): pass"), ("b.py", "used()"), ("c.ts", "export class K {\n  m() {}\n}")], "p string, c string"), F.col("p"), F.col("c"))
    dead = symbols.dead_symbols(files)
    scan.write_json(files, dead, str(tmp_path / "r.json"))
    got = json.load(open(tmp_path / "r.json"))
    assert (got["scannedFiles"], got["deadSymbolCount"]) == (3, 3) and sorted((x["path"], x["name"], x["line"], x.get("end_line")) for x in got["deadSymbols"]) == [("a.py", "lost", 2, None), ("c.ts", "K", 1, 3), ("c.ts", "K.m", 2, 2)]
    scan.write_sarif(dead, str(tmp_path / "r.sarif"), "R1", "Dead", "reason")
    run = json.load(open(tmp_path / "r.sarif"))["runs"][0]
    assert len(run["results"]) == 3 and {x["ruleId"] for x in run["results"]} == {"R1"} and run["tool"]["driver"]["rules"][0]["id"] == "R1"
