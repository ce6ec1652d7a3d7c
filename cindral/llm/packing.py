"""Filling containers of fixed capacity (problem 8).

Harmonic packing: items are put into classes by length, and each class fills its containers with a fixed number of items, without
looking at other workers. With the classes of the textbook (between C/(k+1) and C/k, k items to a container) about a tenth to a
quarter of the space stays empty, so the classes here are the lengths themselves: lengths are whole numbers up to the capacity, hence a
histogram of at most `capacity` numbers says all there is to say, and from it a plan of fixed mixes is made (a mix: so many items of
each of some lengths, used for so many containers), longest first, each container filled with the longest that still fit. Workers then
place items by their rank within their length, independently. `classes="harmonic"` gives the textbook's rule, for comparison.

Items longer than the capacity are divided into full pieces and a rest, no other item is; items without length are left out. Ranks come
from counts of (length, part of a hash of the key) and the order within a part, so no length is gathered in one task, and the outcome
does not depend on which executor did what.

Nulls and odd input: rows with a null key or length, or a length of 0 or less, are left out; repeated keys count once (the longest
length); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.session import cut


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Mixes for items of lengths up to capacity: (containers, [(length, items in each)]), longest lengths first."""
    left = {s: n for s, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        room, mix = capacity, []
        for s in order:
            if s <= room:
                k = min(room // s, left[s])
                mix.append((s, k))
                room -= k * s
                if room < order[-1]:
                    break
        times = min(left[s] // k for s, k in mix)
        for s, k in mix:
            left[s] -= times * k
        order = [s for s in order if left[s]]
        out.append((times, mix))
    return out


def harmonic_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The textbook's rule, as mixes: capacity // length items of a class to a container (a class's lengths in descending order)."""
    out = []
    by_class: dict[int, list[list[int]]] = {}
    for s in sorted(counts, reverse=True):
        by_class.setdefault(capacity // s, []).append([s, counts[s]])
    for k, lengths in by_class.items():
        i = 0
        while i < len(lengths):
            if lengths[i][1] >= k:
                times = lengths[i][1] // k
                out.append((times, [(lengths[i][0], k)]))
                lengths[i][1] -= times * k
            mix, room = [], k
            while i < len(lengths) and room:
                n = min(room, lengths[i][1])
                if n:
                    mix.append((lengths[i][0], n))
                    lengths[i][1] -= n
                    room -= n
                if not lengths[i][1]:
                    i += 1
            if mix:
                out.append((1, mix))
    return out


def packed(items: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacity: int = 2048, classes: str = "lengths", part_rows: int = 1_000_000) -> DataFrame:
    """(key, piece, start, n, bin_id): piece 0.. of each item, its first position and length, and its container."""
    kind = dict(items.dtypes)[key]
    one = items.where(F.col(key).isNotNull() & (F.col(length) > 0)).groupBy(key).agg(F.max(F.col(length).cast("long")).alias("_n"))
    pieces = one.select(F.col(key).alias("_key"), "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / capacity))).alias("piece"))
    pieces = cut(pieces.select("_key", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece") * capacity).alias("n")))
    total = pieces.count()
    parts = max(1, -(-total // part_rows))
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("_key", "piece"), F.lit(parts)).cast("int"))
    sizes = cut(pieces.groupBy("n", "_part").count())
    # At most `capacity` rows.
    counts = {r["n"]: r["c"] for r in sizes.groupBy("n").agg(F.sum("count").alias("c")).collect()}
    mixes = (harmonic_plan if classes == "harmonic" else plan)(counts, capacity)

    # Ranks of all items in one line (lengths ascending); each mix takes a stretch of every length it uses.
    base, at = {}, 0
    for s in sorted(counts):
        base[s], at = at, at + counts[s]
    used, first_bin = dict.fromkeys(counts, 0), 0
    rows = []
    for times, mix in mixes:
        for s, k in mix:
            rows.append((base[s] + used[s], first_bin, k))
            used[s] += times * k
        first_bin += times
    rows.sort()
    begin, bins, each = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3

    spark = items.sparkSession
    lengths = spark.createDataFrame([(int(s), int(b)) for s, b in base.items()], "n long, _base long") if base else spark.createDataFrame([], "n long, _base long")
    before = W.partitionBy("n").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offset = sizes.withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0))).join(F.broadcast(lengths), "n").select("n", "_part", (F.col("_off") + F.col("_base")).alias("_off"))
    ranked = pieces.withColumn("_row", F.row_number().over(W.partitionBy("n", "_part").orderBy("_key", "piece")) - 1).join(offset, ["n", "_part"]).withColumn("_rank", F.col("_off") + F.col("_row"))

    def run(batches):
        for b in batches:
            rank = b["_rank"].to_numpy()
            i = np.searchsorted(begin, rank, side="right") - 1
            b["bin_id"] = bins[i] + (rank - begin[i]) // each[i] if len(rank) else rank
            yield b[["_key", "piece", "start", "n", "bin_id"]]

    return ranked.select("_key", "piece", "start", "n", "_rank").mapInPandas(run, f"_key {kind}, piece long, start long, n long, bin_id long").withColumnRenamed("_key", key)
