import datetime as dt
import math
import random

import numpy as np
import pytest

from cindral.llm import bpe, components as cc, mojibake, overlap, packing
from cindral.llm.nearest_time import nearest_in_time

T0 = dt.datetime(2020, 1, 1)


# --- nearest time ---


def gc(x1, y1, x2, y2):
    p, q = math.radians(y1), math.radians(y2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1.0, math.sqrt(a)))


def test_nearest_against_brute_force(spark):
    g = random.Random(4)
    places = [(-120.0, 40.0), (179.999, 52.0), (10.0, 89.995), (0.0, -89.999), (-180.0, 0.0)]
    row = lambda i: (i, T0 + dt.timedelta(seconds=g.randrange(0, 9000)), *(lambda p: ((p[0] + g.uniform(-0.06, 0.06) + 540) % 360 - 180, max(-90.0, min(90.0, p[1] + g.uniform(-0.03, 0.03)))))(g.choice(places)))
    rec = [row(i) for i in range(600)] + [(9000, None, 0.0, 0.0), (9001, T0, None, 0.0), (None, T0, -120.0, 40.0)]
    rec += [(r[0] + 10_000, *r[1:]) for r in rec[:50]] + rec[:20]  # copies under other keys, repeats
    qs = [row(i) for i in range(200)] + [(5000, None, 0.0, 0.0), (None, T0, 0.0, 0.0), (5001, T0, 500.0, 0.0)]
    schema = "k long, t timestamp, lon double, lat double"
    got = nearest_in_time(spark.createDataFrame(qs, schema).withColumnRenamed("k", "q"), spark.createDataFrame(rec, schema), "q", "k", 900, 2000)
    want = {}
    for q, t, x, y in qs:
        if q is None or t is None or abs(x) > 360:
            continue
        best = min(((abs((t - s).total_seconds()), k) for k, s, u, v in rec if None not in (k, s, u, v) and abs((t - s).total_seconds()) <= 900 and gc(x, y, u, v) <= 2000), default=None)
        if best:
            want[q] = best[1]
    assert {r["q"]: r["k"] for r in got.collect()} == want and len(want) > 50


def test_nearest_limits_and_empty(spark):
    schema = "k long, t timestamp, lon double, lat double"
    a = spark.createDataFrame([(1, T0, 0.0, 0.0)], schema).withColumnRenamed("k", "q")
    b = spark.createDataFrame([(7, T0 + dt.timedelta(seconds=900), 0.0, 0.0), (5, T0 - dt.timedelta(seconds=900), 0.0, 0.0), (3, T0 + dt.timedelta(seconds=901), 0.0, 0.0)], schema)
    assert [tuple(r) for r in nearest_in_time(a, b, "q", "k", 900, 2000).collect()] == [(1, 5, 900_000_000)]
    assert nearest_in_time(a.limit(0), b, "q", "k", 900, 2000).count() == 0 and nearest_in_time(a, b.limit(0), "q", "k", 900, 2000).count() == 0


# --- components ---


def union(pairs):
    top = {}

    def root(v):
        top.setdefault(v, v)
        while top[v] != v:
            v = top[v]
        return v

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    return {v: root(v) for v in top}


@pytest.mark.parametrize("cell_edges", [500_000, 60])
def test_components(spark, cell_edges):
    g = random.Random(2)
    pairs = [(i, i + 1) for i in range(1000, 1300)] + [(5, 10_000 + i) for i in range(200)] + [(g.randrange(20_000, 20_400), g.randrange(20_000, 20_400)) for _ in range(180)]
    pairs += [(1, None), (None, 2), (3, 3), (1000, 1001), (1001, 1000), (-5, -9), (2**62, -(2**62))]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["id"]: r["group_id"] for r in cc.components(df, "a", "b", cell_edges=cell_edges).collect()}
    assert got == union(pairs)


def test_components_empty_and_mix(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert cc.components(df, "a", "b").count() == 0
    v = np.arange(-5000, 5000)
    assert len(np.unique(cc.mixed(v))) == len(v)


def test_event_links(spark):
    df = spark.createDataFrame([("E1", [3, 1]), ("e1 ", [7, None]), ("x", []), ("y", None), (None, [8, 9]), ("z", [4])], "event_id string, det_ids array<long>")
    assert {tuple(r) for r in cc.event_links(df).collect()} == {(3, 1), (7, 1)}


# --- tokens ---


def test_bpe_equals_merging():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    e = bpe.encoder()
    g = random.Random(1)
    signs = [chr(c) for c in range(32, 127)] + list("éñöß°²€“”—…\n\t\r 日本🔥Ã\xa0　")
    texts = ["".join(g.choice(signs if k % 3 else "abaacd th e r") for _ in range(g.randint(1, 60))) for k in range(3000)]
    texts += ["a" * 3000, " " * 2000, "=" * 2001, "ab" * 1500, "<|endoftext|>", "it's we'll", "\n\n \n"]
    for t in texts:
        assert e.encode(t) == ref.encode(t, add_special_tokens=False).ids
    assert bpe.decoded(e.encode("Grüße — 火")) == "Grüße — 火" and e.encode("") == [] and e.encode(None) == []


def test_encoded(spark):
    df = spark.createDataFrame([(1, "a fire", 1), (1, "a fire", 2), (2, None, 3), (3, "", 4), (4, "  ", 5), (None, "x", 6)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df).collect()}
    assert got == {1: bpe.encoder().encode("a fire"), 2: [], 3: [], 4: bpe.encoder().encode("  ")}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encoded(df, counts_only=True).collect()}[1] == 2
    assert bpe.encoded(df.limit(0)).count() == 0


# --- packing ---


@pytest.mark.parametrize("classes", ["lengths", "harmonic"])
def test_packing(spark, classes):
    g = random.Random(3)
    items = [(i, g.choice([g.randint(1, 300), g.randint(1, 1300), 700, g.randint(1, 9000)])) for i in range(3000)] + [(5000, 0), (5001, -3), (5002, None), (None, 7), (5, 1)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long")
    rows = packing.packed(df, capacity=1000, classes=classes, part_rows=500).collect()
    bins, docs = {}, {}
    for r in rows:
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n"]
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n"]))
    best = {}
    for k, n in items:
        if k is not None and n is not None and n > 0:
            best[k] = max(best.get(k, 0), n)
    assert max(bins.values()) <= 1000 and sorted(bins) == list(range(len(bins)))
    assert {k: sum(p[2] for p in v) for k, v in docs.items()} == best
    for k, v in docs.items():
        v.sort()
        assert len(v) == -(-best[k] // 1000) and [p[1] for p in v] == [1000 * i for i in range(len(v))]
    waste = 1 - sum(best.values()) / (1000 * len(bins))
    assert waste < (0.03 if classes == "lengths" else 0.35)
    assert packing.packed(df.limit(0), capacity=1000).count() == 0


# --- garbled text ---

CLEAN = ["Le feu a été signalé près du bâtiment à midi.", "Die Böen drehten über Gräser nach Süden.", "El incendio alcanzó la estación — señal débil.", "Пожар локализован, ветер усилился.", "Η φωτιά έσβησε χθες."]


def corpus():
    g = random.Random(8)
    docs = [(i, " ".join(g.sample(CLEAN, 2)) + f" 4{i % 10} °C") for i in range(60)]
    bad = {
        100: mojibake.misread(CLEAN[0], "cp1252"), 101: mojibake.misread(mojibake.misread(CLEAN[1], "cp1252"), "latin-1"), 102: CLEAN[2].encode("cp1252").decode("cp437"), 103: CLEAN[3].encode("cp1251").decode("koi8-r"),
        104: mojibake.misread(CLEAN[4], "cp1251"), 105: CLEAN[1].encode("latin-1").decode("utf-8", "replace"), 106: "nothing but 41 " + mojibake.misread("°C", "mac_roman"),
    }
    return docs + [*bad.items(), (200, None), (201, ""), (202, " \xa0 "), (203, "plain " * 5000), (None, "x Ã©")], set(bad)


def test_garbled_and_restored(spark):
    rows, bad = corpus()
    df = spark.createDataFrame(rows + rows[:10] + [rows[60]], "doc_id long, text string")
    assert {r["doc_id"] for r in mojibake.garbled(df).collect()} == bad
    got = {r["doc_id"]: r["restored"] for r in mojibake.restored(df).collect()}
    assert got[100] == CLEAN[0] and got[101] == CLEAN[1] and all(w in got[102] for w in ('alcanzó', 'estación', 'señal', 'débil')) and got[103] == CLEAN[3] and got[104] == CLEAN[4] and got[106] == "nothing but 41 °C"
    assert mojibake.garbled(df.limit(0)).count() == 0


def test_forms():
    assert "Ã©" in mojibake.run_forms("é") and mojibake.unread("Ã©", "cp1252") == "é" and mojibake.unread("é", "cp437") is None and mojibake.unread("жар", "cp1251") is None
    for chain in (("cp1252", "koi8-r"), ("cp1252", "latin-1", "cp1252"), ("mac_greek", "cp737", "cp1257")):
        g = "é—ж"
        for p in chain:
            g = mojibake.misread(g, p)
        assert any(f in mojibake.run_forms("é—ж") for f in mojibake.before_readings(g)), chain
    assert mojibake.before_readings("é") == {} and set(mojibake.before_readings("Ã©")) >= {"Ã©", "é"}
    f = mojibake.word_forms("café")
    assert "caf├⌐" not in f and ("cp1252", "cp437") in [mojibake.PAIRS[i] for i in f["cafΘ"]]


def test_all_chains_and_rare_originals(spark):
    """Every page twice and some three times over, originals in one clean document, and what is quoted but not garbled."""
    g = random.Random(3)
    clean = "Die Böen drehten über Gräser — nach Süden"
    chains = [(a, b) for a in mojibake.PAGES for b in mojibake.PAGES] + [tuple(g.choice(mojibake.PAGES) for _ in range(3)) for _ in range(60)]
    rows = [(0, clean)]
    for i, chain in enumerate(chains):
        t = clean
        for p in chain:
            t = mojibake.misread(t, p)
        rows.append((i + 1, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["restored"], r["left"]) for r in mojibake.restored(df).collect()}
    assert set(got) == {i for i in range(1, len(rows))} and set(got.values()) == {(clean, 0)}

    swap = "Žižka šířil požár přes příkré úbočí"
    two = spark.createDataFrame([(1, swap), (2, swap + " dál"), (3, swap.encode("cp1250").decode("cp1252")), (4, "the sign � is quoted"), (5, "a � b"), (6, "Süd und Nord"), (7, "S�d und Nord"), (8, "z�zz")], "doc_id long, text string")
    got = {r["doc_id"]: (r["restored"], r["left"]) for r in mojibake.restored(two).collect()}
    assert got == {3: (swap, 0), 7: ("Süd und Nord", 0), 8: ("z�zz", 1)}


def test_an_original_that_is_garbled_is_no_original(spark):
    once = mojibake.misread("Süden", "cp1252")
    twice = mojibake.misread(once, "cp852")
    df = spark.createDataFrame([(1, "nach Süden"), (2, f"nach {once}"), (3, f"nach {twice}"), (4, f"{mojibake.misread('Bøjle', 'cp1252')} {twice}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["restored"], r["left"]) for r in mojibake.restored(df).collect()}
    assert got[2] == got[3] == ("nach Süden", 0) and got[4][1] == 0
    alone = spark.createDataFrame([(2, f"nach {once}"), (3, f"nach {twice}")], "doc_id long, text string")
    assert {r["doc_id"]: r["left"] for r in mojibake.restored(alone).collect()}.get(3, 0) in (0, 1)


# --- overlap ---

UNITS = "uid string, lon double, lat double, when_date date, group_id string, ecoregion string, label_source string, fire_name string, area_ha double"


def day(m, d, y=2020):
    return dt.date(y, m, d)


def test_overlaps(spark):
    u = [
        ("a", -110.0, 40.0, day(7, 1), "g1", "e1", "s", "Salt Spring", 100.0), ("b", -110.003, 40.002, day(7, 9, 2022), None, "E1", "s", "salt-spring FIRE", 100.4), ("c", -110.0, 40.0, day(7, 1, 2021), "g1", "e1", "s", None, 99.0),
        ("d", -110.001, 40.001, day(7, 1), "g2", "e1", "s", "Iron Rim", 40.0), ("e", -110.0, 41.0, day(7, 1), "g3", "e1", "s", "Salt Spring", 100.0), ("f", -110.012, 40.0, day(7, 5), "g1", "e1", "s", "Salt Spring", 60.0),
        ("g", None, 40.0, None, None, None, None, None, None), ("h", 179.999, 50.0, day(6, 1), None, None, "s", "Date Line", 50.0), ("i", -179.998, 50.001, day(6, 2), None, None, "s", "Daet Line", 50.2),
    ]
    parts = [(0, "train", "a"), (0, "test", "b"), (0, "val", "c"), (0, "test", "d"), (0, "test", "e"), (0, "test", "f"), (0, "train", "g"), (0, "val", "g"), (0, "train", "h"), (0, "test", "i"), (1, "test", "a"), (1, "train", "c"), (1, "train", "b"), (0, None, "a"), (None, "test", "a"), (0, "test", None), (0, "train", "zz"), (0, "test", "zz")]
    df, m = spark.createDataFrame(u + u[:2], UNITS), spark.createDataFrame(parts + parts[:3], "fold int, split_name string, uid string")
    got = {(r["fold"], r["split_name"], r["uid_a"], r["uid_b"]) for r in overlap.overlaps(df, m).collect()}
    assert got == {(0, "test", "a", "b"), (0, "val", "a", "c"), (0, "val", "g", "g"), (0, "test", "h", "i"), (1, "test", "a", "b"), (1, "test", "a", "c"), (0, "test", "zz", "zz")}
    rep = {(r["fold"], r["split_name"], r["label_source"]): (r["records"], r["overlapping"]) for r in overlap.overlap_report(df, m).collect()}
    assert rep[(0, "test", "s")] == (5, 2)
    assert overlap.overlaps(df.limit(0), m).count() == 2 and overlap.overlaps(df, m.limit(0)).count() == 0


def test_two_shifted_recordings_overlap(spark):
    # Copies of one fire, each up to 0.005 degrees from it, are up to 0.01 apart; another part of the group at that distance is no copy.
    u = [
        ("a", -109.84, 35.14, day(10, 10), None, None, "s", "ibex-lake", 448.0), ("b", -109.8303, 35.1497, day(10, 23, 2019), "g1", "e1", "s", "Ibex  Lake", 450.4), ("c", -109.823, 35.14, day(10, 10), None, None, "s", "Ibex Lake", 448.0),
        ("d", -107.5484, 36.2, day(9, 19), "g2", "e1", "s", "Knoll Ridge", 28.3), ("e", -107.5404, 36.2, day(9, 9), "g2", "e1", "s", "Knoll Ridge", 28.0), ("f", -107.5404, 36.2, day(9, 19, 2021), None, "e1", "s", "Umber Gap", 28.3),
    ]
    parts = [(0, "train", "a"), (0, "test", "b"), (0, "test", "c"), (0, "train", "d"), (0, "test", "e"), (0, "test", "f")]
    got = overlap.overlaps(spark.createDataFrame(u, UNITS), spark.createDataFrame(parts, "fold int, split_name string, uid string"))
    assert {(r["uid_a"], r["uid_b"]) for r in got.collect()} == {("a", "b")}


def test_overlaps_without_area(spark):
    # A misspelled or cut name still meets where one or both of the records have no area; other names, seasons and parts of a group do not.
    u = [
        ("a", -110.0, 40.0, day(7, 1), None, "e1", "s", "Dusty Summit", 300.0), ("b", -110.004, 40.003, day(7, 9, 2022), None, "e1", "s", "Dusty Su.", None), ("c", -110.001, 40.0, day(7, 2), None, "e1", "s", "Umber Gap", None),
        ("d", -100.0, 45.0, day(8, 1), None, None, "s", "Salt Sprnig", None), ("e", -100.003, 45.0, day(8, 1, 2019), None, None, "s", "Salt  Sprinng", None), ("f", -100.0, 45.001, day(2, 1), None, None, "s", "Salt Spring", 9.0),
        ("g", -90.0, 35.0, day(5, 1), "g1", None, "s", "Iron Rim", None), ("h", -90.004, 35.0, day(5, 9), "g1", None, "s", "Iron Rim", 50.0), ("i", -90.003, 35.0, day(11, 1, 2018), "g1", None, "s", "Irno Rim", 50.0),
    ]
    parts = [(0, "train" if k in "bdg" else "test", k) for k in "abcdefghi"]
    df, m = spark.createDataFrame(u, UNITS), spark.createDataFrame(parts, "fold int, split_name string, uid string")
    assert {(r["uid_a"], r["uid_b"]) for r in overlap.overlaps(df, m).collect()} == {("a", "b"), ("d", "e"), ("g", "i")}
    from pyspark.sql import functions as F

    turned = m.withColumn("split_name", F.when(F.col("split_name") == "train", "test").otherwise("train"))
    assert {(r["uid_a"], r["uid_b"]) for r in overlap.overlaps(df, turned).collect()} == {("a", "b"), ("d", "e"), ("g", "i")}


def test_every_similar_pair_is_found(spark):
    """Names of 3 to 40 letters, swapped, dropped, doubled, replaced or cut, at one place with one size: the join finds what the rule accepts, on either side, with and without area."""
    g = random.Random(11)
    word = lambda n: "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def changed(w):
        for _ in range(g.choice([1, 1, 2, 2, 3])):
            i = g.randrange(len(w))
            how = g.choice("swap drop double replace cut".split())
            if how == "swap" and i + 1 < len(w):
                w = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
            elif how == "drop" and len(w) > 2:
                w = w[:i] + w[i + 1 :]
            elif how == "double":
                w = w[:i] + w[i] + w[i:]
            elif how == "replace":
                w = w[:i] + g.choice("abcxyz") + w[i + 1 :]
            elif how == "cut":
                w = w[: max(3, len(w) - g.randint(1, 8))]
        return w

    rows, parts = [], []
    for k in range(1800):
        w = word(3 + k % 38)
        at = (-120.0 + 0.5 * (k % 60), 30.0 + 0.5 * (k // 60))
        areas = g.choice([(80.0, 80.0), (80.0, 80.0), (None, 80.0), (80.0, None), (None, None)])
        for side, name, area in (("a", w, areas[0]), ("b", changed(w), areas[1])):
            rows.append((f"{side}{k}", *at, day(7, 1), None, None, "s", name, area))
            parts.append((0, "train" if (side == "a") == (k % 2 == 0) else "test", f"{side}{k}"))
    u, m = spark.createDataFrame(rows, UNITS), spark.createDataFrame(parts, "fold int, split_name string, uid string")
    from pyspark.sql import functions as F

    r = overlap._records(u, "uid")
    s = lambda p: r.where(F.col("uid").startswith(p)).select(F.substring("uid", 2, 9).alias("k"), F.struct(*r.columns).alias(p))
    want = {int(x["k"]) for x in s("a").join(s("b"), "k").where(overlap.same_fire()).collect()}
    got = {int(x["uid_a"][1:]) for x in overlap.overlaps(u, m).collect()}
    assert got == want and len(want) > 1200


def test_hot_name_and_place(spark):
    # A third of the records share name and place (a default), with other sizes: they are told apart before any pair is made.
    u = [(f"h{i}", -100.0, 40.0, day(7, 1), None, None, "s", "Unnamed", 20.0 * 1.07**i) for i in range(160)] + [("x", -100.0, 40.0, day(7, 2, 2021), None, None, "s", "Unnmaed", 20.0 * 1.07**50)]
    m = spark.createDataFrame([(0, "train" if i % 2 else "test", f"h{i}") for i in range(160)] + [(0, "train", "x")], "fold int, split_name string, uid string")
    assert {(r["uid_a"], r["uid_b"]) for r in overlap.overlaps(spark.createDataFrame(u, UNITS), m).collect()} == {("h50", "x")}


def test_rows_of_one_key_that_differ(spark):
    u = [("a", -100.0, 40.0, day(7, 1), None, None, "s", None, 9.0), ("a", -100.0, 40.0, day(7, 1), None, None, "s", "Salt Spring", 9.0), ("b", -100.0, 40.0, day(7, 1), None, None, "s", "Salt Spring", 9.0)]
    m = spark.createDataFrame([(0, "train", "a"), (0, "test", "b")], "fold int, split_name string, uid string")
    for rows in (u, u[::-1]):
        assert [r["chain"] for r in overlap.overlap_pairs(spark.createDataFrame(rows, UNITS), m).collect()] == [11]


def test_selected_share_a_hash(spark):
    from pyspark.sql import functions as F

    names = [("xxwillowgulch", "zzzwillowgulchq"), ("ab", "ab"), ("abcde", "xabcdey"), ("abcd", "acbd")]
    d = spark.createDataFrame(names, "a string, b string").select(overlap.selected(F.col("a")).alias("a"), overlap.selected(F.col("b")).alias("b"))
    for r in d.collect():
        assert {x["h"] for x in r["a"]} & {x["h"] for x in r["b"]}
