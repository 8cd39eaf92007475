"""Whole documents against a plain writer, byte by byte."""

import json

import pytest

from quern import documents


def test_a_document_equals_a_plain_writer(spark, tmp_path):
    texts = {k: f"n<{k} é \"q\"" for k in range(300)}
    rows = spark.createDataFrame([(k, json.dumps({"id": t}, ensure_ascii=False)) for k, t in texts.items()], "id int, text string").repartition(7)
    registry = spark.createDataFrame([('a"b', '{"x":1}'), ("b", "2")], "k string, value string").select("k", documents.map_entry("k").alias("text"))
    entries = [("version", "3"), ("blockers", documents.Section(registry, ["k"], "{}")), ("none", documents.Section(rows.limit(0), ["id"])), ("findings", documents.Section(rows, ["id"]))]
    lines = documents.document(spark, entries)
    want = ["{", '"version":3,', '"blockers":{', '"a\\"b":{"x":1},', '"b":2', "},", '"none":[', "],", '"findings":[']
    want += [json.dumps({"id": t}, ensure_ascii=False) + ("," if k < 299 else "") for k, t in texts.items()] + ["]", "}"]
    path = str(tmp_path / "report.json")
    documents.write(lines, path)
    with open(path, "rb") as f:
        assert f.read() == ("\n".join(want) + "\n").encode()
    assert json.loads("\n".join(want))["findings"][7] == {"id": texts[7]}
    with pytest.raises(FileExistsError):
        documents.write(lines, path)
    # Nothing but the file is left.
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["report.json"]
    documents.write(documents.page(lines, "A < B & C"), path + ".html")
    with open(path + ".html", encoding="utf-8") as f:
        page = f.read().splitlines()
    assert page[:3] == ["<!doctype html>", "<title>A &lt; B &amp; C</title>", '<script type="application/json" id="report">'] and page[-1] == "</script>"
    assert json.loads("\n".join(page[3:-1])) == json.loads("\n".join(want)) and not any("<" in x for x in page[3:-1])


def test_a_document_of_nothing(spark, tmp_path):
    documents.write(documents.document(spark, [("findings", documents.Section(spark.createDataFrame([], "id int, text string"), ["id"]))]), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"findings": []}
