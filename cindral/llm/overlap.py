"""Same or near-same records across splits (problem 6).

Winnowing fingerprints: a record's text is its normalised name between two marks. Rolling hashes of `K` letters of it are taken, the
smallest of every window of neighbours is selected, and selected hashes (with the place cell and the size class they belong to) are
joined between records of the train part and records of the other parts. The window is the widest that loses no pair: names that
`_similar` accepts keep a stretch of at least as many common hashes, whatever was swapped, dropped, doubled or cut (see `window`). Shared
seeds are chained by diagonal; pairs that share fewer seeds than the allowed edits leave are dropped, the others extended by aligning the
whole names, and the pair is decided by the letters that the alignment leaves uncovered, by place, size and date. Records whose name is
missing have no text to select from; the join takes them by place cell and size class alone. Named records without area are joined by
selected hashes and place cell, and decided by place, name and season or group. Such keys are only made in cells that have such
records.

Because every selected hash carries place and size class, a name or a place that a third of all records share does not bring records
together that cannot be the same. Two records of one fire are told from neighbours at the same place by name and size, from others of
that name by place, and from other parts of one group by place, size and date together.

Nulls and odd input: records without key or position take part only under their own key (in two parts of a fold); exact repeats count
once, of different rows with one key the largest (by columns in order, nulls smallest) is taken; unknown parts and null folds are
ignored; empty tables give empty results. A name without letters or digits counts as missing; an area of 0 or less counts as missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindral.session import checked, cut

K = 2  # letters of a rolling hash
NEAR, FAR = 0.0066, 0.0178  # degrees: named records that date and group would make other parts of a group, records without name
WIDE = 0.011  # degrees: named records otherwise; two recordings are each shifted or rounded by up to 0.005, plus a tenth
SIZE = 0.968  # smallest ratio of two areas of one fire
SEASON = 31  # days by which a date may be off, whatever the year
SHORT, LONG = 5, 9  # letters from which two, three edits are one name misspelled; shorter names must be equal
CUT = 8  # letters that may be cut off a name
CELLS = 16  # a cell of place or size is this many times as wide as the reach, so that a record looks into few


def normal_name(c: Column) -> Column:
    """Letters and digits in lower case without a closing `fire`; null if nothing is left."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    short = F.regexp_replace(plain, "(.)fire$", "$1")
    return F.when(short != "", short)


def window(n: Column) -> Column:
    """Hashes in a window for a name of n letters: the longest stretch of common hashes that every similar name shares with it.

    A name of n letters between two marks has n + 1 hashes of two letters, and an edit changes at most two neighbouring ones. Three edits
    leave n - 5 in at most four stretches. Of a name cut by up to `CUT` letters n - CUT hashes of the shorter are left, less two edits, in
    at most three stretches. A wider window on one side selects hashes that a narrower one on the other side selects too.
    """
    return F.greatest(F.lit(1), F.least(F.ceil((n - 5) / 4), F.ceil((n - CUT - 4) / 3))).cast("int")


def selected(name: Column) -> Column:
    """Array of (h, pos): the winnowed rolling hashes of a name."""
    marked, n = F.concat(F.lit("^"), name, F.lit("$")), F.char_length(name)
    grams = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.struct(F.xxhash64(F.substring(marked, i, F.lit(K))).alias("h"), i.alias("pos")))
    wide = F.array_distinct(F.transform(F.sequence(F.lit(1), n + 2 - window(n)), lambda j: F.array_min(F.slice(grams, j, window(n)))))
    return F.when(window(n) == 1, grams).otherwise(wide)


def _records(units: DataFrame, key: str) -> DataFrame:
    area = F.col("area_ha").cast("double")
    u = units.where(F.col(key).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        F.col(key).alias("uid"), (F.pmod(F.col("lon").cast("double") + 180.0, F.lit(360.0))).alias("x"), F.col("lat").cast("double").alias("y"), normal_name(F.col("fire_name")).alias("name"),
        F.when(area > 0, area).alias("area"), F.col("when_date").cast("date").alias("day"), F.col("group_id").alias("grp"), F.lower("ecoregion").alias("eco"), F.col("label_source").alias("label_source"),
    )
    return u.groupBy("uid").agg(F.max(F.struct(*u.columns[1:])).alias("r")).select("uid", "r.*")


def _steps(v: Column, lo: Column, hi: Column, step: float, probe: bool) -> Column:
    """The step that v is in, or (probe) all steps from lo to hi."""
    return F.sequence(F.floor(lo / step), F.floor(hi / step)) if probe else F.array(F.floor(v / step))


def _cells(u: DataFrame, probe: bool) -> DataFrame:
    """u with its place cell (cx, cy), or (probe) one row for each cell within reach; cells divide the circle evenly."""
    turn = math.floor(360.0 / (CELLS * FAR))
    width, x, y = 360.0 / turn, F.col("x"), F.col("y")
    around = F.transform(_steps(x, x - FAR, x + FAR, width, probe), lambda c: F.pmod(c, F.lit(turn)))
    return u.withColumn("cx", F.explode(around)).withColumn("cy", F.explode(_steps(y, y - FAR, y + FAR, width, probe)))


def _odd(u: DataFrame) -> DataFrame:
    """(cx, cy, nameless, bare): cells with records without name, with named records without area."""
    nameless, bare = F.col("name").isNull(), F.col("name").isNotNull() & F.col("area").isNull()
    d = u.where(nameless | F.col("area").isNull()).groupBy("cx", "cy").agg(F.max(nameless).alias("nameless"), F.max(bare).alias("bare"))
    return checked(cut(d), 32)


def _keys(d: DataFrame, probe: bool, odd: DataFrame) -> DataFrame:
    """(h, uid, pos): fingerprint keys of the records of _cells; the probing side looks into all size classes within reach.

    odd: the other side's cells with records that lack name or area. Kinds of keys: 0 a selected hash within a size class; 1 and 2 the size
    class alone, for a record without name on either side; 3 and 4 a selected hash alone, for a named record without area on either side;
    5 group and day, for records without area.
    """
    reach = -math.log(SIZE) * 1.001
    area, step = F.col("area"), CELLS * reach
    # Areas may differ by a share or, where rounded, by half a hectare.
    lo = F.least(F.log(area) - reach, F.log(F.greatest(area - 0.5, F.lit(0.05))))
    hi = F.greatest(F.log(area) + reach, F.log(area + 0.5))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    size = F.when(area.isNotNull(), _steps(F.log(area), lo, hi, step, probe)).otherwise(none("bigint"))
    seeds = F.when(F.col("name").isNotNull(), F.col("seeds")).otherwise(none("struct<h:bigint,pos:int>"))
    mine, other = (2, 1) if probe else (1, 2)
    d = d.join(odd, ["cx", "cy"], "left").select("uid", "name", "area", "cx", "cy", "grp", "day", F.coalesce("nameless", F.lit(False)).alias("nameless"), F.coalesce("bare", F.lit(False)).alias("bare"), size.alias("size"), seeds.alias("seeds"))
    hashed = lambda kind, *c: F.xxhash64(F.lit(kind), F.col("cx"), F.col("cy"), *c)
    key = lambda h, pos: F.struct(h.alias("h"), pos.cast("int").alias("pos"))
    plain, empty = F.lit(0), none("struct<h:bigint,pos:int>")
    sized = F.flatten(F.transform("size", lambda s: F.transform("seeds", lambda g: key(hashed(0, s, g["h"]), g["pos"]))))
    by_size = lambda kind, when: F.when(when, F.transform("size", lambda s: key(hashed(kind, s), plain))).otherwise(empty)
    by_name = lambda kind, when: F.when(when, F.transform("seeds", lambda g: key(hashed(kind, g["h"]), g["pos"]))).otherwise(empty)
    lacks = F.col("name").isNull() | F.col("area").isNull()
    group = F.when(F.col("grp").isNotNull() & (lacks | F.col("nameless") | F.col("bare")), F.array(key(hashed(5, F.col("grp"), F.date_format("day", "MMdd")), plain))).otherwise(empty)
    keys = F.concat(sized, by_size(mine, F.col("name").isNull()), by_size(other, F.col("nameless")), by_name(mine + 2, F.col("area").isNull()), by_name(other + 2, F.col("bare")), group)
    return d.select("uid", F.explode(keys).alias("k")).select("uid", F.col("k.h").alias("h"), F.col("k.pos").alias("pos"))


def edits(n: Column) -> Column:
    """Edits that a name of n letters (the shorter of two) may have to be the other misspelled."""
    return F.when(n >= LONG, 3).when(n >= SHORT, 2).otherwise(0)


def _similar(a: Column, b: Column) -> Column:
    """Whether one name can be the other misspelled (letters swapped or doubled) or cut short."""
    n = F.least(F.char_length(a), F.char_length(b))
    start = F.levenshtein(F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n))
    return (a == b) | ((n >= SHORT) & ((F.levenshtein(a, b) <= edits(n)) | ((start <= 2) & (F.abs(F.char_length(a) - F.char_length(b)) <= CUT))))


def enough_seeds(seeds: Column, a: Column, b: Column) -> Column:
    """Whether two names share as many seeds as the allowed edits leave at least; where a window selects fewer than all hashes, one."""
    n, m = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    left = F.when(n >= LONG, n - 5).when(n >= SHORT, n - 4).otherwise(1)
    return seeds >= F.when(window(m) == 1, F.greatest(left, F.lit(1))).otherwise(1)


def same_fire(a: str = "a", b: str = "b") -> Column:
    """Whether records a and b (struct columns of _records) are of one fire at one place."""
    c = lambda s, f: F.col(f"{s}.{f}")
    dx = F.abs(c(a, "x") - c(b, "x"))
    dx, dy = F.least(dx, 360.0 - dx), F.abs(c(a, "y") - c(b, "y"))
    both = lambda f: c(a, f).isNotNull() & c(b, f).isNotNull()
    yes = lambda e: F.coalesce(e, F.lit(False))
    big, small = F.greatest(c(a, "area"), c(b, "area")), F.least(c(a, "area"), c(b, "area"))
    size = both("area") & ((small >= SIZE * big) | (big - small <= 0.5))
    equal_size = (small >= 0.995 * big) | (big - small <= 0.5)
    group = yes(c(a, "grp") == c(b, "grp"))
    same_day = yes(F.date_format(c(a, "day"), "MMdd") == F.date_format(c(b, "day"), "MMdd"))
    apart = F.abs(F.date_diff(c(a, "day"), c(b, "day")))
    part = group & both("day") & ~same_day & (apart <= SEASON)  # as other parts of a group are
    doy = F.abs(F.dayofyear(c(a, "day")) - F.dayofyear(c(b, "day")))
    season = F.least(doy, 365 - doy) <= SEASON
    name = both("name")
    similar = yes(_similar(c(a, "name"), c(b, "name")))
    near, wide = (dx <= NEAR) & (dy <= NEAR), (dx <= WIDE) & (dy <= WIDE)
    named = name & wide & ((size & similar & ((near & equal_size) | ~part)) | (~both("area") & similar & (yes(F.coalesce(season, F.lit(True))) | group) & ((dx + dy == 0) | ~part)))
    eco = yes(c(a, "eco") == c(b, "eco"))
    loose = F.when(both("day"), season & (eco | ~both("eco"))).otherwise(eco)
    unnamed = ~name & (dx <= FAR) & (dy <= FAR) & ((size & ((group & ((dx + dy == 0) | ~part)) | (~group & loose))) | (~both("area") & group & same_day))
    return named | unnamed


def overlap_pairs(units: DataFrame, parts: DataFrame, key: str = "uid") -> DataFrame:
    """(train, other, seeds, chain, cover_train, cover_other): verified pairs of different records, one in a train part and one in another part of any fold.

    seeds: selected hashes they share; chain: the most on one diagonal; cover: share of a record's name that the alignment covers (null
    without names).
    """
    member = parts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("uid")).agg(F.max(F.col("split_name") == "train").alias("is_train"), F.max(F.col("split_name") != "train").alias("is_other"))
    u = cut(_records(units, key).join(member, "uid"))
    rec = F.struct(*(F.col(c) for c in u.columns if c not in ("is_train", "is_other")))
    with_seeds = u.withColumn("seeds", selected(F.col("name")))
    home, around = _cells(with_seeds.where("is_train"), False), _cells(with_seeds.where("is_other"), True)
    left = _keys(home, False, _odd(around)).select("h", F.col("uid").alias("train"), F.col("pos").alias("i"))
    right = _keys(around, True, _odd(home)).select("h", F.col("uid").alias("other"), F.col("pos").alias("j"))
    met = left.join(right, "h").where("train <> other").groupBy("train", "other", (F.col("i") - F.col("j")).alias("diagonal")).agg(F.count_distinct(F.when(F.col("i") > 0, F.col("i"))).alias("n"))
    pairs = met.groupBy("train", "other").agg(F.sum("n").alias("seeds"), F.max("n").alias("chain"))
    pairs = pairs.join(u.select(F.col("uid").alias("train"), rec.alias("a")), "train").join(u.select(F.col("uid").alias("other"), rec.alias("b")), "other")
    unnamed = F.col("a.name").isNull() | F.col("b.name").isNull()
    # Pairs may also meet by size or group alone (0 seeds); names that share too few seeds cannot be similar.
    pairs = pairs.where((unnamed | enough_seeds(F.col("seeds"), F.col("a.name"), F.col("b.name"))) & same_fire())
    kept = F.greatest(F.char_length("a.name"), F.char_length("b.name")) - F.levenshtein("a.name", "b.name")
    return pairs.select("train", "other", "seeds", "chain", F.least(F.lit(1.0), kept / F.char_length("a.name")).alias("cover_train"), F.least(F.lit(1.0), kept / F.char_length("b.name")).alias("cover_other"))


def _members(parts: DataFrame, key: str) -> DataFrame:
    return parts.where(F.col(key).isNotNull() & F.col("fold").isNotNull() & F.col("split_name").isin("train", "val", "test")).select("fold", "split_name", F.col(key).alias("uid")).distinct()


def overlaps(units: DataFrame, parts: DataFrame, key: str = "uid") -> DataFrame:
    """(fold, split_name, uid_a, uid_b, train, other, cover_train, cover_other) of every overlap; uid_a <= uid_b."""
    m = cut(_members(parts, key))
    train = m.where("split_name = 'train'").select("fold", F.col("uid").alias("train"))
    other = m.where("split_name <> 'train'").select("fold", "split_name", F.col("uid").alias("other"))
    one = train.withColumn("other", F.col("train")).join(other, ["fold", "other"]).select("fold", "split_name", "train", "other", F.lit(1.0).alias("cover_train"), F.lit(1.0).alias("cover_other"))
    pairs = overlap_pairs(units, m, "uid")
    two = pairs.join(train, "train").join(other, ["fold", "other"]).select("fold", "split_name", "train", "other", "cover_train", "cover_other")
    return one.unionByName(two).select("fold", "split_name", F.least("train", "other").alias("uid_a"), F.greatest("train", "other").alias("uid_b"), "train", "other", "cover_train", "cover_other")


def overlap_report(units: DataFrame, parts: DataFrame, key: str = "uid") -> DataFrame:
    """(fold, split_name, label_source, records, overlapping, mean_cover): overlaps of each part and source; records: all of the part and source."""
    src = units.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("other")).agg(F.max("label_source").alias("label_source"))
    m = _members(parts, key).where("split_name <> 'train'").withColumnRenamed("uid", "other")
    found = overlaps(units, parts, key).groupBy("fold", "split_name", "other").agg(F.max("cover_other").alias("cover"))
    return m.join(src, "other", "left").join(found, ["fold", "split_name", "other"], "left").groupBy("fold", "split_name", "label_source").agg(F.count("*").alias("records"), F.count("cover").alias("overlapping"), F.round(F.avg("cover"), 6).alias("mean_cover"))
