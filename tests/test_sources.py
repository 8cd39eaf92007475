"""Sources on small inputs."""

import json

import pytest

from quern.sources import project


def text(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_files(spark, tmp_path):
    for name in ("lib/a.dart", "build/out", "lib/.git/x", "b.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("abc")
    assert {(r.path, r.size_bytes) for r in project.files(spark, str(tmp_path)).collect()} == {("lib/a.dart", 3), ("b.txt", 3)}


def test_diagnostics(spark):
    lines = ["INFO|HINT|UNUSED_ELEMENT|a.dart|2|3|4|one|two", "INFO|HINT|UNUSED_ELEMENT|a.dart|9|1|1|beyond", "short|line", "INFO|HINT|OTHER|a.dart|1|1|1|m", "INFO|HINT|UNUSED_ELEMENT|a.dart|x|1|1|m", ""]
    log = project.machine_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = project.diagnostics(log, text(spark, [("a.dart", "first\nsecond\n")]), ["unused_element"]).collect()
    assert [(r.offset, r.length, r.message) for r in got] == [(8, 4, "one|two")]


def test_messages(spark):
    rows = [("l/app_en.arb", '{"hi": "Hi", "@hi": {"x": 1}}'), ("l/app_zh_Hant.arb", '{"hi": "x"}'), ("l/app_de.arb", '{"hi": "a", "hi": "b"}'), ("l/app_fr.arb", '{"@@locale": "es"}'), ("l/app.arb", "{}"), ("l/app_it.arb", "no")]
    found, issues = project.messages(text(spark, rows), "l/app_en.arb")
    assert {tuple(r) for r in found.collect()} == {("hi", "en", True, "Hi"), ("hi", "zh_Hant", False, "x")}
    assert {tuple(r) for r in issues.collect()} == {("l/app_de.arb", "repeated keys"), ("l/app_fr.arb", "locale differs from the name"), ("l/app.arb", "no locale"), ("l/app_it.arb", "not an object")}


def test_packages_and_assets(spark):
    one = json.dumps({"configVersion": 2, "packages": [{"name": "a", "rootUri": "../a"}, {"name": "b", "rootUri": "../b"}]})
    assert {tuple(r) for r in project.packages(text(spark, [("x", one)])).collect()} == {("a", "../a"), ("b", "../b")}
    for bad in (one.replace('"b"', '"a"'), one.replace("2,", "1,"), "[]"):
        assert project.packages(text(spark, [("x", bad)])).count() == 0
    listing = spark.createDataFrame([("i/a.png", 1), ("i/sub/b.png", 2), ("j/c.png", 3)], "path string, size_bytes long")
    assert {r.path for r in project.declared_assets(listing, spark.createDataFrame([("i/",), ("j/c.png",)], "entry string")).collect()} == {"i/a.png", "j/c.png"}


def test_config(spark):
    c = {"version": 1, "target_matrix": {"complete": True, "targets": [{"name": "a", "platform": "ios", "entrypoint": "m"}]}}
    assert project.targets(spark, project.config(json.dumps(c))).count() == 1
    for change in ({"version": 2}, {"other": 1}, {"target_matrix": {"targets": c["target_matrix"]["targets"] * 2}}):
        with pytest.raises(ValueError):
            project.config(json.dumps(c | change))
