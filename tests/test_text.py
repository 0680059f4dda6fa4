"""Text rules on small fixtures: nulls, empty and malformed texts, borders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wrenchlake.functions import text as T


def one(spark, value, rule, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(rule(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "text, codes",
    [(None, []), ("", []), ("p0301 and P0301, B12C4", ["P0301"]), ("U1A23 C1234 b1234", ["C1234", "U1A23"]), ("XP03011", [])],
)
def test_codes(spark, text, codes):
    assert one(spark, text, T.extract_codes) == codes


def test_code_validity(spark):
    assert [one(spark, c, T.valid_code) for c in (" p0301 ", "B1A23", "P030", "", None, "P03011")] == [True, True, False, False, False, False]


def test_sensors(spark):
    assert one(spark, "RPM: 2500, coolant temp = 90 and 14.5 g/s", T.extract_sensors) == {"engine_rpm": 2500.0, "coolant_temp": 90.0, "maf_sensor": 14.5}
    assert one(spark, "nothing", T.extract_sensors) == {}
    raw = spark.sql("SELECT map('Engine RPM', '900', 'Coolant-Temp', '999', 'other', '7', 'bad', 'x', 'engine_rpm', '800') AS x")
    assert raw.select(T.normalize_sensors(F.col("x"))).first()[0] == {"engine_rpm": 800.0, "other": 7.0}


def test_vehicle(spark):
    v = one(spark, "My bmw from 2011, n54 engine; mileage: 1,234", T.extract_vehicle)
    assert (v.make, v.year, v.engine, v.mileage) == ("Bmw", 2011, "N54", 1234)
    assert tuple(one(spark, "", T.extract_vehicle)) == (None, None, None, None)


def test_outcome_order(spark):
    assert [one(spark, t, T.classify_outcome) for t in ("not fixed", "it failed", "somewhat ok", "", None)] == ["success", "failure", "partial", "unknown", "unknown"]


def test_summary(spark):
    assert one(spark, "  short ", T.repair_summary) == "short"
    assert one(spark, None, T.repair_summary) == ""
    long = "Intro. " * 80 + "We replaced the coil. It runs. " + "Tail. " * 20
    assert one(spark, long, T.repair_summary) == "replaced the coil. It runs."
    plain = "One two three. " * 60
    got = one(spark, plain, T.repair_summary)
    assert got.startswith("One two three. One") and got.endswith(".") and len(got) <= 560


@pytest.mark.parametrize("text, want", [("x" * 49, False), ("replaced " + "x" * 41, True), ("x" * 80 + " pump", True), ("x" * 99, False), ("x" * 100, True), (None, False)])
def test_substantial(spark, text, want):
    assert one(spark, text, T.substantial) is want


@pytest.mark.parametrize("n, sizes", [(0, [0]), (1200, [1200]), (1201, [1200, 201]), (2100, [1200, 1100, 100])])
def test_chunks(spark, n, sizes):
    assert [len(c) for c in one(spark, "x" * n, T.chunks)] == sizes


def test_titles(spark):
    assert one(spark, "plain", T.truncate_title) == "plain"
    listed = ", ".join(f"A{i:03d}" for i in range(100))
    got = one(spark, listed, T.truncate_title)
    assert got.endswith("more)") and len(got) <= 200
    words = "word " * 60
    assert one(spark, words, T.truncate_title) == ("word " * 40).rstrip() + "..."
    assert one(spark, None, T.truncate_title) == ""


def test_preview(spark):
    assert one(spark, "a" * 60 + " Cause: b", lambda c: T.preview(c, 100)) == "a" * 49 + " Cause: b"
    assert one(spark, "y" * 600, T.preview) == "y" * 500 + "..."
    assert one(spark, None, T.preview) == ""


def test_steps(spark):
    assert one(spark, "1. Open hood\n2) Close hood", T.repair_steps) == ["Open hood", "Close hood"]
    assert one(spark, "- a\n* b", T.repair_steps) == ["a", "b"]
    assert one(spark, "short\n" + "z" * 21, T.repair_steps) == ["z" * 21]
    assert one(spark, None, T.repair_steps) == []


def test_urls(spark):
    assert one(spark, "http://f.x/showthread.php?t=12&p=3#post", T.normalize_url) == "thread_t_12"
    assert one(spark, "http://f.x/threads/title.77/", T.normalize_url) == "thread_t_77"
    assert one(spark, "http://f.x/a/#b", T.normalize_url) == "http://f.x/a"
    assert one(spark, None, T.normalize_url) == ""


def test_nav_links(spark):
    assert [one(spark, t, T.nav_link) for t in ("", "12", "Next", "page 3", "Misfire on cylinder 2", "x" * 81)] == [True, True, True, True, False, False]


def test_code_truncation(spark):
    cut = lambda v: one(spark, v, T.truncate_codes, "array<string>")
    assert cut([]) == ["P0000"] and cut(None) == ["P0000"] and cut(["P0000", "2A"]) == ["2A"]
    assert cut([f"{i}Z" for i in range(9)] + ["U1", "P1"])[:3] == ["P1", "U1", "0Z"]


def test_tolerant_json(spark):
    parse = lambda v: one(spark, v, lambda c: T.tolerant_json(c, "a int, b string"))
    assert tuple(parse('```json\n{"a": 1, "b": "x",}\n```')) == (1, "x")
    assert parse("none") is None


def test_problem_solution(spark):
    assert one(spark, "Problem: the engine misfires at idle. Fix: replace all of the coils now.", T.problem_solution) == " Problem/Solution: the engine misfires at idle; replace all of the coils now"
    assert one(spark, "Problem: x", T.problem_solution) == ""
