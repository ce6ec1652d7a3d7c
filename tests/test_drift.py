import json

import pytest

from cindral.operators.drift import drift, leaves, lineages, unified
from cindral.operators.ordered import carried
from pyspark.sql import functions as F

SCHEMA = "feed_id string, file_no int, file_id long, line_no int, body string"


def lines(files, feed="f"):
    return [(feed, n, n * 10, i, b if isinstance(b, str) or b is None else json.dumps(b)) for n, rows in files for i, b in enumerate(rows)]


FILES = [
    (1, [{"det_id": 1, "conf": 0.5, "a": {"x": 1}, "flag": True}, {"det_id": 2, "conf": 0.7, "a": {"x": 2}, "flag": False}, "{bad", None, "[1]"]),
    (2, [{"det_id": 2, "Conf": "0,7", "a": {"x": 2}, "flag": False, "new": 1}, {"det_id": 3, "Conf": "0,9", "a": {"x": 3}, "flag": None, "new": None}]),
    (4, [{"det_id": 3, "Conf": None, "b.c": 3, "flag": None}, {"det_id": 4, "Conf": None, "b.c": 4, "flag": None}]),
    (5, [{"det_id": 4, "Conf": 0.5, "b.c": 4, "flag": "yes"}, {"det_id": 4, "Conf": 0.5, "b.c": 4, "flag": "yes"}, {"det_id": 5, "Conf": 0.1, "b.c": 5, "flag": True}]),
]
WANT = {(20, "Conf", "renamed"), (20, "Conf", "retyped"), (20, "new", "added"), (40, "new", "removed"), (40, "b.c", "renamed"), (50, "Conf", "retyped"), (50, "flag", "retyped")}


def test_changes(spark):
    got = drift(spark.createDataFrame(lines(FILES), SCHEMA))
    changes = {(r["file_id"], r["field_name"], r["change_kind"]) for r in got["changes"].collect()}
    assert changes == WANT  # flag: one string (repeats count once) and one boolean in file 50; string comes first
    names = {(r["old"], r["new"]) for r in got["renames"].collect()}
    assert names == {("conf", "Conf"), ("a.x", "b.c")}
    alt = {(r["file_id"], r["path"]): r["alternatives"] for r in got["schemas"].collect()}
    assert alt[(20, "flag")] == {"boolean": 1, "null": 1} and alt[(50, "flag")] == {"string": 1, "boolean": 1}


def table(df):
    got = drift(df)
    names = lineages(got["schemas"], got["renames"])
    return unified(df, got["schemas"], names, ["file_id", "line_no"]), {(r["feed_id"], r["path"]): r["field"] for r in names.collect()}


def test_unified(spark):
    df = spark.createDataFrame(lines(FILES), SCHEMA)
    got, names = table(df)
    assert names[("f", "conf")] == names[("f", "Conf")] == "Conf" and names[("f", "a.x")] == names[("f", "b.c")] == "a.x"
    assert dict(got.dtypes) == {"file_id": "bigint", "line_no": "int", "Conf": "double", "Conf__number": "double", "Conf__string": "string", "a.x": "double", "det_id": "double", "flag": "boolean", "flag__string": "string", "flag__boolean": "boolean", "new": "double"}
    rows = {(r["file_id"], r["line_no"]): r for r in got.collect()}
    assert rows[(10, 0)]["Conf"] == 0.5 and rows[(20, 0)]["Conf"] == 0.7 and rows[(20, 0)]["Conf__string"] == "0,7" and rows[(20, 0)]["Conf__number"] is None
    assert rows[(50, 0)]["flag"] is None and rows[(50, 0)]["flag__string"] == "yes" and rows[(10, 0)]["flag"] is True and rows[(40, 0)]["a.x"] == 3.0
    assert len(rows) == 9


def test_unified_keeps_feeds_apart_and_odd_names(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}, "a.b": 2, "a_b": 3, "A_B": 4, "file_id": 5, "x`y": "s", "x": 1, "x__number": True}
    rows = lines([(1, [{"det_id": 1, "p": 1.5}, {"det_id": 2, "p": 2.5}]), (2, [{"det_id": 2, "q": 2.5}, {"det_id": 3, "q": 9.5}])], "one")
    rows += lines([(1, [{"det_id": 1, "q": "a", "x": "t"}]), (2, [{"det_id": 2, "q": "b"}])], "two") + [("three", 1, 77, 0, json.dumps(deep))]
    got, names = table(spark.createDataFrame(rows, SCHEMA))
    assert names[("one", "p")] == names[("one", "q")] == names[("two", "q")] == "q" and names[("three", "a.b.c.d.e.f.g.h")] == "a.b.c.d.e.f.g.h"
    (r,) = [r for r in got.collect() if r["file_id"] == 77]
    assert r["a.b.c.d.e.f.g.h"] == 1 and r["a.b"] == 2 and r["a_b_"] == 3 and r["A_B"] == 4 and r["file_id_"] == 5 and r["x`y"] == "s" and r["x__number"] is True and r["x__number_"] == 1.0
    with pytest.raises(ValueError, match="more than 2 fields"):
        d = drift(got_ := spark.createDataFrame(rows, SCHEMA))
        unified(got_, d["schemas"], lineages(d["schemas"], d["renames"]), ["file_id"], most=2)


def test_odd_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift(empty)["changes"].count() == 0
    only_bad = spark.createDataFrame([("f", 1, 1, 0, "{"), ("f", 2, 2, 0, '{"det_id": 1}'), (None, 3, 3, 0, "{}"), ("f", None, 4, 0, '{"a": 1}')], SCHEMA)
    assert drift(only_bad)["changes"].count() == 0
    long = json.dumps({"det_id": 1, "s": "x" * 200_000})
    assert drift(spark.createDataFrame([("f", 1, 1, 0, long)], SCHEMA))["schemas"].count() == 2


def test_deep_leaves(spark):
    body = json.dumps({"a": {"b": {"c": {"d": {"e": 5}}}}, "l": [1, 2], "o": {}, "n": None})
    df = spark.createDataFrame([(1, body)], "k int, body string")
    assert {(r["path"], r["kind"]) for r in leaves(df, ["k"]).collect()} == {("a.b.c.d.e", "number"), ("l", "array"), ("n", "null")}


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_carried(spark, width):
    rows = [("a", i, v) for i, v in enumerate([None, 1, None, None, 2, None, 3])] + [("b", 5, None), ("b", 9, 7), ("b", 10, None)]
    d = carried(spark.createDataFrame(rows, "k string, n int, v int"), ["k"], "n", F.col("v"), "last", width)
    assert {(r["k"], r["n"]): r["last"] for r in d.collect()} == {("a", 0): None, ("a", 1): None, ("a", 2): 1, ("a", 3): 1, ("a", 4): 1, ("a", 5): 2, ("a", 6): 2, ("b", 5): None, ("b", 9): None, ("b", 10): 7}


def test_any_depth_and_unreadable_lines(spark):
    body = lambda n: "{\"a\":" * n + "1" + "}" * n
    df = spark.createDataFrame(lines([(1, [body(7), body(300), body(200_000), '{"b": {}}', '{"n": NaN}', '{"s": "\\ud800"}', '{"s": 1} x'])]), SCHEMA)
    assert {r["path"] for r in leaves(df, ["file_id"]).collect()} == {".".join("a" * 7), ".".join("a" * 300), "s"}
    assert {r["path"] for r in drift(df)["schemas"].collect()} == {".".join("a" * 7), ".".join("a" * 300), "s"}


def brute(rows):
    """Changes of well-behaved files by plain dictionaries: no renames, every file has readable lines."""
    files, out = {}, set()
    for feed, n, file, _, b in rows:
        files.setdefault((feed, n), (file, set()))[1].add(b)
    known, before = {}, {}
    for (feed, n), (file, bodies) in sorted(files.items()):
        kinds = {}
        for b in bodies:
            for k, v in json.loads(b).items():
                kinds.setdefault(k, []).append({int: "number", float: "number", str: "string", bool: "boolean", type(None): None}[type(v)])
        last, now = before.get(feed), {}
        for k, v in kinds.items():
            some = [x for x in v if x]
            now[k] = max(("number", "string", "boolean"), key=lambda x: (some.count(x), -("number", "string", "boolean").index(x))) if some else (last or {}).get(k)
        if last is not None:
            out |= {(file, k, "added") for k in now.keys() - last.keys()} | {(file, k, "removed") for k in last.keys() - now.keys()}
            out |= {(file, k, "retyped") for k in now.keys() & last.keys() if any(kinds[k]) and last[k] and now[k] != last[k]}
        before[feed] = now
    return out


def test_against_brute_force(spark):
    import random

    g = random.Random(6)
    rows = []
    for feed in ("f", "g"):
        for n in range(1, 25):
            have = [k for k in "abcde" if g.random() < 0.8]
            kind = {k: g.choice(["n", "n", "n", "s", "b", None]) for k in have}
            for i in range(g.randint(2, 6)):
                # Records are never re-sent, so nothing can be a rename.
                o = {"det_id": len(rows) * 10 + i} | {k: {"n": i + 0.5, "s": f"t{i}", "b": bool(i % 2), None: None}[kind[k] if g.random() < 0.9 else "s"] for k in have}
                rows.append((feed, n, n * 2 + (feed == "g"), i, json.dumps(o)))
    got = drift(spark.createDataFrame(rows, SCHEMA))["changes"].collect()
    assert {(r["file_id"], r["field_name"], r["change_kind"]) for r in got} == brute(rows)
