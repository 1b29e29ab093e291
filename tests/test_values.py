"""Names, keys, maps, JSON values and settings."""

import pytest
from pyspark.sql import functions as F

from quillforge.functions import values as V
from quillforge.operators import config as C


def one(spark, value, expression, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expression(F.col("x"))).first()[0]


def test_names_and_sizes(spark):
    assert one(spark, "--a b/c!--", V.clean_run_id) == "a-b-c" and one(spark, None, V.clean_run_id) == "run" and len(one(spark, "x" * 300, V.clean_run_id)) == 128
    assert [one(spark, n, V.byte_size, "x bigint") for n in (0, 1023, 1024, 1587, 5 << 20, 3 << 40)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 MiB", "3.0 TiB"]
    assert [one(spark, v, V.truth) for v in ("Yes", " off ", "maybe", None)] == [True, False, None, None]


def test_globs_and_renames(spark):
    hit = lambda p, g: one(spark, p, lambda c: V.ignored(c, g))
    assert hit("a/b.tmp", ["*.tmp"]) and hit("a/b.txt", ["b.*"]) and not hit("a/b.txt", ["c*", "?.tmp"]) and not hit("a+b", ["a.b"]) and not hit("x", [])
    rules = [("model.language.", "language."), ("model.", "m.")]
    assert [one(spark, k, lambda c: V.renamed(c, rules)) for k in ("model.language.x", "model.y", "z", "model.")] == ["language.x", "m.y", "z", "m."]


def test_logs_and_answers(spark):
    m = {"loss": "0.5", "name": "x", "train_runtime": "3", "nan": "NaN", "n": "2"}
    got = one(spark, m, V.numeric_log, "x map<string,string>")
    assert got["train/loss"] == 0.5 and got["train/n"] == 2.0 and set(got) == {"train/loss", "train/n", "train/nan"}
    assert [one(spark, v, V.message_content) for v in ('"hi"', '[{"text": "a"}, {"image": 1}, {"text": "b"}]', "{}", "oops", None)] == ["hi", "ab", "", "", ""]
    use = lambda v: one(spark, v, lambda c: V.usage_field(c, "total_tokens"))
    assert [use(v) for v in ('{"usage": {"total_tokens": 7}}', '{"usage": {}}', "x", None)] == [7, None, None, None]


def test_settings():
    groups = {"model": {"small": {"size": 1, "name": "${data.name}"}, "large": {"size": 9}}, "data": {"main": {"name": "pool", "deep": {"a": 1, "b": 2}}}}
    base = {"model": "small", "data": "main"}
    assert C.composed(groups, base)["model"] == {"size": 1, "name": "pool"}
    got = C.composed(groups, base, ["model=large", "data.deep.b=off", "data.deep.c=[1, 2]"])
    assert got["model"] == {"size": 9} and got["data"]["deep"] == {"a": 1, "b": False, "c": [1, 2]}
    for bad in (["model=huge"], ["nonsense"], ["data.name=${data.name}"], ["data.name=${no.such}"]):
        with pytest.raises(ValueError):
            C.composed(groups, base, bad)
    assert C.digest({"a": 1, "b": 2}) == C.digest({"b": 2, "a": 1})
    assert C.device_groups([0, 1, 2, 3], 2) == [[0, 1], [2, 3]]
    for devices, each in (([0, 1, 2], 2), ([0, 0], 1), ([0], 0)):
        with pytest.raises(ValueError):
            C.device_groups(devices, each)
    assert (C.stage_end(None, 101, 50), C.stage_end(7, 101, 50), C.stage_end(7, 101, 50, 5)) == (3, 7, 5)
