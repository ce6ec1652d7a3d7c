"""Schemas that drift between files (problem 2).

Tagged-union inference: every JSON line is parsed once and reduced to its shape, the set of its leaves with their JSON types. The parallel
shapes of a file's lines are fused into one schema that keeps every alternative type of a path with its count, and successive files of a
feed are compared: paths that appear, vanish, change type, or carry on under another name. A rename is seen in the records that a file
re-sends from the file before: the vanished and the new field carry the same content there, in canonical form; only lines of files that
have both a vanished and a new field are read for it. `unified` reads everything into one table: each lineage of names within a feed is
one field; a field of one type is one column, conflicting types are split into typed branches beside a canonical column.

Lines are parsed in Arrow batches in Python: leaves at any depth and under any key need recursion, which Columns do not have. Fields are
compared as they are spelled, letter case counts; nested ones are written with a dot.

Nulls and odd input: lines that are null or not complete JSON objects (or nested deeper than the parser goes, about 1,000 levels) are
ignored, files of which no line can be read take no part; exact repeats of a line within a file count once (by a 128-bit digest); an
empty table gives empty results; arrays are leaves of type `array`; objects without fields are no leaves; of repeated keys in an
object the last counts. A file's type of a field is that of most of its non-null values (ties: the first of number, string, boolean,
array); a file with nulls only keeps the type known last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cindral.operators.ordered import carried
from cindral.session import checked, cut

KINDS = ("number", "string", "boolean", "array")
_KIND = {int: "number", float: "number", str: "string", bool: "boolean", list: "array", type(None): "null"}


def _constant(name: str):
    raise ValueError(name)


_parse = json.JSONDecoder(parse_constant=_constant).decode  # NaN and Infinity are not JSON


def parsed(body: str | None) -> dict | None:
    """The object of a line, or None."""
    try:
        v = _parse(body) if body else None
    except (ValueError, RecursionError):
        return None
    return v if type(v) is dict else None


def leaves_of(v: dict) -> Iterator[tuple[str, object]]:
    """(path, value) of every leaf, at any depth."""
    open_ = [("", v)]
    while open_:
        head, v = open_.pop()
        for k, x in v.items():
            if type(x) is dict:
                open_.append((f"{head}{k}.", x))
            else:
                yield head + k, x


def _text(v: object) -> str | None:
    if v is None or type(v) is str:
        return v
    return "true" if v is True else "false" if v is False else json.dumps(v, ensure_ascii=False)


def _sound(s: str) -> str:
    """Text that UTF-8 can write (single surrogates become question marks)."""
    return s.encode("utf-8", "replace").decode() if not s.isascii() else s


def _at(v: dict, keys: list[str]) -> object:
    for k in keys:
        v = v.get(k) if type(v) is dict else None
    return v


def _rows(b, names: list[str], at: list[int]) -> dict:
    """Columns of a batch at some of its rows; texts as plain objects, which every version of pandas hands over alike."""
    return {c: v.astype(object) if v.dtype.kind not in "iufbM" else v for c in names for v in [b[c].take(at).reset_index(drop=True)]}


def leaves(lines: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """(keep..., path, kind, value) of every leaf of every readable line; value is the leaf as a string."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in lines.select(*keep).dtypes)

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(i, _sound(p), _KIND[type(x)], None if x is None else _sound(_text(x))) for i, t in enumerate(b["_body"].values) if (v := parsed(t)) is not None for p, x in leaves_of(v)]
            at = [r[0] for r in out]
            plain = {n: pd.Series([r[j] for r in out], dtype=object) for j, n in ((1, "path"), (2, "kind"), (3, "value"))}
            yield pd.DataFrame({**_rows(b, keep, at), **plain})

    return lines.select(*keep, F.col(body).alias("_body")).mapInPandas(run, f"{kinds}, path string, kind string, value string")


def _shapes(lines: DataFrame, feed: str, number: str, file: str) -> DataFrame:
    """(feed, number, file, shape, digest) of every readable line: shape is the JSON text of its sorted (path, kind) pairs."""
    kinds = dict(lines.dtypes)

    def run(batches):
        from hashlib import blake2b

        import pyarrow as pa

        known: dict[tuple, str] = {}
        for b in batches:
            shape, digest, at = [], [], []
            for i, t in enumerate(b.column("_body").to_pylist()):
                v = parsed(t)
                if v is None:
                    continue
                key = tuple((p, type(x)) for p, x in leaves_of(v))
                text = known.get(key)
                if text is None:
                    if len(known) > 10_000:
                        known.clear()
                    text = known[key] = json.dumps(sorted({(_sound(p), _KIND[k]) for p, k in key}), ensure_ascii=False)
                shape.append(text)
                digest.append(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                at.append(i)
            rest = b.take(pa.array(at, pa.int64())).select([feed, number, file])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(shape, pa.string()), pa.array(digest, pa.binary())], names=[feed, number, file, "shape", "digest"])

    return lines.mapInArrow(run, f"`{feed}` {kinds[feed]}, `{number}` {kinds[number]}, `{file}` {kinds[file]}, shape string, digest binary")


def canonical(value: Column, kind: Column) -> Column:
    """Content without its spelling: numbers (also as text, with a decimal comma or a unit) as a rounded number, other text trimmed and lower case."""
    text = F.trim(value)
    as_double = number_in(value)
    rounded = F.when(as_double == 0, "0").otherwise(F.format_string("%.9e", as_double))
    return F.when(kind.isin("number", "string") & as_double.isNotNull(), rounded).otherwise(F.lower(text))


def number_in(value: Column) -> Column:
    """The number that a text holds, with a decimal comma or a unit or not; null if none."""
    found = F.regexp_extract(F.trim(value), r"^([+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)(?:\s*[A-Za-z%°²³/]+[0-9]?)?$", 1)
    return F.regexp_replace(F.when(found != "", found), ",", ".").try_cast("double")


def file_schemas(lines: DataFrame, feed: str, number: str, file: str, body: str) -> DataFrame:
    """One row for each field of a file: path, the alternatives (a map from kind to count), and main, the kind of most non-null values."""
    base = lines.where(F.col(feed).isNotNull() & F.col(number).isNotNull() & F.col(body).isNotNull())
    shapes = _shapes(base.select(feed, number, file, F.col(body).alias("_body")), feed, number, file)
    shapes = shapes.distinct().groupBy(feed, number, file, "shape").agg(F.count("*").alias("_lines"))
    leaf = shapes.select(feed, number, file, "_lines", F.explode(F.from_json("shape", "array<array<string>>")).alias("f"))
    kind = F.get("f", F.lit(1))
    counts = [F.sum(F.when(kind == k, F.col("_lines")).otherwise(0)).alias(f"n_{k}") for k in (*KINDS, "null")]
    df = leaf.groupBy(feed, number, file, F.get("f", F.lit(0)).alias("path")).agg(*counts)
    best = F.greatest(*(F.col(f"n_{k}") for k in KINDS))
    main = F.coalesce(*(F.when((best > 0) & (F.col(f"n_{k}") == best), k) for k in KINDS))
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n")) for k in (*KINDS, "null")))
    return df.select(feed, number, file, "path", F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0)).alias("alternatives"), main.alias("main"))


def _contents(lines: DataFrame, wanted: DataFrame, feed: str, number: str, record: str, body: str) -> DataFrame:
    """(feed, _to, _file, _rec, side, path, type, content): the wanted fields of the lines of the wanted files.

    wanted: feed, number (file to read), _to, _file (file compared), side, path, type.
    """
    per_file = wanted.groupBy(feed, number).agg(F.collect_list(F.struct("_to", "_file", "side", "path", "type")).alias("_want"))  # fields of one file
    read = lines.where(F.col(body).isNotNull()).select(feed, number, F.col(body).alias("_body")).join(checked(cut(per_file), 512), [feed, number])
    kinds, name = dict(lines.dtypes), record.split(".")
    got = f"`{feed}` {kinds[feed]}, _rec string, path string, kind string, value string, _want {dict(per_file.dtypes)['_want']}"

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for f, t, want in zip(b[feed].values, b["_body"].values, b["_want"].values):
                v = parsed(t)
                if v is None or (rec := _text(_at(v, name))) is None:
                    continue
                asked: dict[str, list] = {}
                for w in want:
                    asked.setdefault(w["path"], []).append(w)
                seen: dict[str, object] = {}
                for p, x in leaves_of(v):
                    if x is not None and (p := _sound(p)) in asked:
                        seen[p] = x
                out += [(f, _sound(rec), p, _KIND[type(x)], _sound(_text(x)), asked[p]) for p, x in seen.items()]
            names = [feed, "_rec", "path", "kind", "value", "_want"]
            yield pd.DataFrame({n: pd.Series([r[j] for r in out], dtype=object if j else b[feed].dtype if b[feed].dtype.kind in "iuf" else object) for j, n in enumerate(names)})

    rows = read.mapInPandas(run, got).select(feed, "_rec", "path", canonical(F.col("value"), F.col("kind")).alias("content"), F.explode("_want").alias("w"))
    return rows.select(feed, "w._to", "w._file", "_rec", "w.side", "path", "w.type", "content")


def drift(lines: DataFrame, feed: str = "feed_id", number: str = "file_no", file: str = "file_id", record: str = "det_id", body: str = "body", same: float = 0.8) -> dict[str, DataFrame]:
    """changes (file, field_name, change_kind, old_name), schemas (file_schemas) and renames (feed, number, file, old, new).

    record: the field that names a record, by which re-sent records are found. same: share of the re-sent records with both fields
    filled that must have equal content for a rename.
    """
    # Fields of each file, with the number of the file before (_n0), of the last file with the path, and the type known last.
    schemas = cut(file_schemas(lines, feed, number, file, body))
    files = cut(carried(schemas.select(feed, number, file).distinct(), [feed], number, F.col(number), "_n0"))
    fields = schemas.select(feed, number, "path", "main").join(files, [feed, number])
    fields = carried(fields, [feed, "path"], number, F.col(number), "_seen")
    fields = fields.withColumn("_start", ~F.coalesce(F.col("_seen") == F.col("_n0"), F.lit(False)))
    fields = carried(fields, [feed, "path"], number, F.when(F.col("_start") | F.col("main").isNotNull(), F.struct("main")), "_known")
    last = F.coalesce("main", F.when(~F.col("_start"), F.col("_known.main"))).alias("last")
    fields = cut(fields.select(feed, number, file, "_n0", "path", "main", last))

    # Each file beside the one before it: what was, what is.
    none = F.lit(None).cast("string")
    new = fields.where(F.col("_n0").isNotNull()).select(feed, number, file, "_n0", "path", none.alias("_old"), F.col("main").alias("_new"), F.lit(0).alias("_was"), F.lit(1).alias("_is"))
    after = files.where(F.col("_n0").isNotNull()).select(feed, F.col(number).alias("_number"), F.col(file).alias("_file"), F.col("_n0").alias(number))
    old = fields.select(feed, number, "path", "last").join(after, [feed, number])
    old = old.select(feed, F.col("_number").alias(number), F.col("_file").alias(file), F.col(number).alias("_n0"), "path", F.col("last").alias("_old"), none.alias("_new"), F.lit(1).alias("_was"), F.lit(0).alias("_is"))
    both = new.unionByName(old).groupBy(feed, number, file, "_n0", "path").agg(*(F.max(c).alias(c) for c in ("_old", "_new", "_was", "_is")))
    both = cut(both.where("_was + _is = 1 OR _old <> _new"))  # what is as it was needs no further look

    # Content of gone and new fields in the records that both files have, of files with both.
    side = F.when(F.col("_is") == 0, "old").otherwise("new")
    moved = both.where("_was + _is = 1").withColumn("side", side)
    two = moved.groupBy(feed, number).agg(F.count_distinct("side").alias("_sides")).where("_sides = 2").select(feed, number)
    wanted = moved.join(two, [feed, number]).select(
        feed, F.col(number).alias("_to"), F.col(file).alias("_file"), F.when(F.col("side") == "old", F.col("_n0")).otherwise(F.col(number)).alias(number), "path", "side", F.coalesce("_old", "_new").alias("type")
    )
    seen = _contents(lines, wanted, feed, number, record, body)
    seen = seen.groupBy(feed, "_to", "_file", "_rec").agg(F.collect_set(F.struct("side", "path", "type", "content")).alias("f"))
    olds, news = F.filter("f", lambda x: x["side"] == "old"), F.filter("f", lambda x: x["side"] == "new")
    pair = lambda o, n: F.struct(o["path"].alias("old"), n["path"].alias("new"), o["type"].alias("a"), n["type"].alias("b"), (o["content"] == n["content"]).alias("equal"))
    pairs = seen.select(feed, "_to", "_file", "_rec", F.explode(F.flatten(F.transform(olds, lambda o: F.transform(news, lambda n: pair(o, n))))).alias("p"))
    pairs = pairs.groupBy(feed, F.col("_to").alias(number), F.col("_file").alias(file), "_rec", "p.old", "p.new", "p.a", "p.b").agg(F.max("p.equal").alias("equal"))
    pairs = pairs.groupBy(feed, number, file, "old", "new", "a", "b").agg(F.count("*").alias("n"), F.count_if("equal").alias("k"))
    pairs = pairs.where(F.col("k") >= F.greatest(F.lit(1.0), same * F.col("n")))
    # One old name for each new name and the other way round: the pair with most equal records, then by name.
    order = [F.desc("k"), F.desc(F.col("k") / F.col("n"))]
    place = lambda c, then: F.row_number().over(W.partitionBy(feed, number, c).orderBy(*order, then))
    pairs = pairs.withColumn("_i", place("old", "new")).withColumn("_j", place("new", "old"))
    renames = cut(pairs.where("_i = 1 and _j = 1").select(feed, number, file, "old", "new", "a", "b"))

    row = lambda df, name, kind, before: df.select(file, F.col(name).alias("field_name"), F.lit(kind).alias("change_kind"), before.alias("old_name"))
    marks = moved.select(feed, number, file, "path", "side", F.lit(0).alias("_renamed"))
    for k in ("old", "new"):
        marks = marks.unionByName(renames.select(feed, number, file, F.col(k).alias("path"), F.lit(k).alias("side"), F.lit(1).alias("_renamed")))
    plain = marks.groupBy(feed, number, file, "path", "side").agg(F.max("_renamed").alias("_renamed")).where("_renamed = 0")
    changes = plain.select(file, F.col("path").alias("field_name"), F.when(F.col("side") == "new", "added").otherwise("removed").alias("change_kind"), none.alias("old_name"))
    changes = changes.unionByName(row(both.where("_was + _is = 2 and _old <> _new"), "path", "retyped", F.col("path")))
    changes = changes.unionByName(row(renames, "new", "renamed", F.col("old"))).unionByName(row(renames.where("a <> b"), "new", "retyped", F.col("old")))
    return {"changes": changes, "schemas": schemas, "renames": renames.select(feed, number, file, "old", "new")}


def lineages(schemas: DataFrame, renames: DataFrame, feed: str = "feed_id") -> DataFrame:
    """(feed, path, field): the names that renames link within one feed are one lineage, called by that of its names which most files of
    all feeds have (ties: by name). What one feed calls a field says nothing of another feed's; names shared as they are stay one field.

    Lineages are followed inside each feed over its distinct names and renames, of which there are few, however many files there are.
    """
    used = schemas.groupBy("path").agg(F.count("*").alias("_files"))
    names = schemas.select(feed, "path").distinct().join(used, "path").select(feed, F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), "_files")
    links = renames.select(feed, F.col("old").alias("a"), F.col("new").alias("b")).distinct().withColumn("_files", F.lit(None).cast("long"))
    kind = dict(schemas.dtypes)[feed]

    def run(p):
        import pandas as pd

        own = p[p["b"].isna()]
        files = dict(zip(own["a"], own["_files"]))
        top = {a: a for a in files}

        def root(v):
            while top[v] != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        for a, b in p.loc[p["b"].notna(), ["a", "b"]].sort_values(["a", "b"]).values:
            a, b = sorted((root(a), root(b)), key=lambda v: (-files[v], v))
            top[b] = a
        return pd.DataFrame({feed: p[feed].iloc[0], "path": list(top), "field": [root(a) for a in top]})

    return names.unionByName(links).groupBy(feed).applyInPandas(run, f"`{feed}` {kind}, path string, field string")


def unified(lines: DataFrame, schemas: DataFrame, lineage: DataFrame, keep: list[str], feed: str = "feed_id", body: str = "body", most: int = 10_000) -> DataFrame:
    """One consistent table: keep, then the fields by name.

    A field whose values are of one JSON type everywhere is one column of that type. One with conflicting types has the canonical column
    `f` of its commonest type (values of the others converted, null where they cannot be) and a branch for each type, `f__number`,
    `f__string`, `f__boolean`, `f__array` (as JSON text), which hold the values as they were. A field with nulls only is a string. Names
    that clash without regard to case, or with those of keep, get underscores. Raises if there are more than `most` fields: they
    are columns. No shuffle of the lines unless the names of the feeds are too many to broadcast.
    """
    typed = schemas.select(feed, "path", F.explode("alternatives").alias("kind", "n")).where("kind <> 'null'").groupBy(feed, "path", "kind").agg(F.sum("n").alias("n"))
    typed = lineage.join(typed, [feed, "path"], "left").groupBy("field").pivot("kind", list(KINDS)).agg(F.sum("n"))
    rows = typed.orderBy("field").limit(most + 1).collect()  # one row for each column of the result
    if len(rows) > most:
        raise ValueError(f"more than {most} fields")
    index = {r["field"]: i for i, r in enumerate(rows)}
    # Only names that differ from their field's need to be told to the lines of a feed.
    other = lineage.where("path <> field").groupBy(feed).agg(F.map_from_entries(F.collect_list(F.struct("path", "field"))).alias("_names"))
    src = lines.select(*keep, *({feed} - set(keep)), F.col(body).alias("_body")).join(checked(cut(other), 1024), feed, "left")
    kinds = ", ".join(f"`{c}` {t}" for c, t in lines.select(*keep).dtypes)

    def run(batches):
        import pandas as pd

        none = (None, None)
        for b in batches:
            values, types, at = [], [], []
            for i, (t, names) in enumerate(zip(b["_body"].values, b["_names"].values)):
                v = parsed(t)
                if v is None:
                    continue
                own = dict(names) if names is not None else {}
                got: dict[int, tuple] = {}
                for p, x in leaves_of(v):
                    p = _sound(p)
                    k = index.get(own.get(p, p))
                    if k is not None and x is not None and k not in got:
                        got[k] = (_sound(_text(x)), _KIND[type(x)])
                row = [got.get(k, none) for k in range(len(index))]
                values.append([r[0] for r in row])
                types.append([r[1] for r in row])
                at.append(i)
            yield pd.DataFrame({**_rows(b, keep, at), "_v": pd.Series(values, dtype=object), "_k": pd.Series(types, dtype=object)})

    df = src.mapInPandas(run, f"{kinds}, _v array<string>, _k array<string>")
    taken, out = {c.lower() for c in keep}, []

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    # Fields first, so that a branch gives way to a field of its name.
    named = {r["field"]: free(r["field"]) for r in rows}
    for r in rows:
        i, have = index[r["field"]], [k for k in KINDS if r[k]]
        raw, kind = F.get("_v", F.lit(i)), F.get("_k", F.lit(i))
        main = max(have, key=lambda k: (r[k], -KINDS.index(k))) if have else "string"
        as_ = {"number": number_in(raw), "string": raw, "array": raw, "boolean": F.when(F.lower(F.trim(raw)).isin("true", "false"), F.lower(F.trim(raw)) == "true")}
        if len(have) < 2:
            as_["number"] = raw.try_cast("double")
        out.append(as_[main].alias(named[r["field"]]))
        if len(have) > 1:
            own = {"number": raw.try_cast("double"), "string": raw, "array": raw, "boolean": raw == "true"}
            out += [F.when(kind == k, own[k]).alias(free(f"{named[r['field']]}__{k}")) for k in have]
    return df.select(*keep, *out)
