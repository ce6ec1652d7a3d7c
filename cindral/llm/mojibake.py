"""Garbled text from wrong character encoding (problem 9).

The corpus is its own dictionary. Its distinct words with letters or signs beyond ASCII are counted (by documents), the garbled forms of
every one under the chains of encodings are generated, and the words of the documents are hash-joined against that table. Two kinds of
chains, two units:

* UTF-8 read as one of the code pages, `DEPTH` times in a row, with any page each time. Bytes of other than ASCII characters stay beyond
  ASCII, so the unit is the run of such characters; a run that is the garbled form of a run of the corpus is wrong, and the run it was made
  from is the original. A single letter of another script is little (two signs of print can look like it), so it must also be
  commoner than its form. The table holds the forms of the first reading; the later readings are taken back from the document's side, where
  hardly any run can have them (its bytes must be UTF-8 again), so that all 20 x 20 x 20 chains cost the table of one.
* One code page read as another. The map goes both ways, so the unit is the word, and one of two spellings is the right one: that in at
  least `ratio` times as many documents (for words of one character, which say less, `alone` times), or, however rare it is, that to which
  `together` or more words of one document go back by the same two pages, if none of them is commoner than its original, and together
  they are rarer.
* Characters already lost (U+FFFD): a word that is a word of the corpus with its characters beyond ASCII lost, or in which the sign stands
  at a letter, is wrong; the original is the only word with the same rest, if there is one.

`restored` substitutes verified originals in the affected documents; an original that is itself garbled is replaced by its own, and
what stays garbled is counted. Words are counted over whole texts and all documents; digits in a word are one placeholder for counting
and are put back when restoring.

Nulls and odd input: null, empty and pure ASCII texts are never cases; a null key has no row; repeated rows count once; an empty table
gives an empty result; a word in very many documents is counted before it is shuffled.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindral.session import BROADCAST_BYTES, checked, cut

# The code pages (by their Python names) that texts are read as or come from.
PAGES = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "mac_roman", "mac_cyrillic", "mac_greek", "cp437", "cp850", "cp852", "cp737", "cp1254", "cp1257")
#: Readings of a UTF-8 chain.
DEPTH = 3

# A word: ASCII letters and digits and everything beyond ASCII, with at least one of the latter. The look-behind keeps long ASCII runs linear.
WORD = r"(?<![A-Za-z0-9])[A-Za-z0-9]*+[^\x00-\x7F][^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+"
RUN = r"[^\x00-\x7F]+"
LOST = "�"


@lru_cache(None)
def _reading(page: str) -> dict[int, str]:
    """Byte (as a character) -> character; bytes that the page leaves open stay as control characters, as common decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def misread(text: str, page: str) -> str:
    """UTF-8 bytes of text read as a page."""
    return text.encode("utf-8", "replace").decode("latin-1").translate(_reading(page))


def run_forms(run: str) -> set[str]:
    """Garbled forms of a run after one reading of its UTF-8 bytes."""
    return {misread(run, p) for p in PAGES} - {run}


@lru_cache(None)
def _writing(page: str) -> dict[int, str]:
    """Character -> byte (as a character); what the page has not becomes a character that no byte is."""
    return {c: "\uffff" for c in range(128, 256)} | {ord(c): chr(b) for b, c in sorted(_reading(page).items(), reverse=True)}


def unread(text: str, page: str) -> str | None:
    """The text whose UTF-8 bytes read as a page give `text`; None if there is none."""
    try:
        return text.translate(_writing(page)).encode("latin-1").decode("utf-8")
    except UnicodeError:
        return None


def before_readings(run: str) -> dict[str, int]:
    """What a run can have been before its last 0 .. DEPTH - 1 readings (text -> readings taken back); empty if it cannot have been read at all."""
    known, level = {run: 0}, {run}
    for k in range(1, DEPTH + 1):
        level = {u for g in level for p in PAGES if (u := unread(g, p)) is not None} - known.keys()
        if not level:
            break
        if k < DEPTH:
            known |= dict.fromkeys(level, k)
    return known if len(known) > 1 or level else {}


PAIRS = [(a, b) for a in PAGES for b in PAGES if a != b]


def word_forms(word: str) -> dict[str, list[int]]:
    """Garbled forms of a word under one page read as another: form -> the pairs of pages (as indices of PAIRS) that make it."""
    out: dict[str, list[int]] = {}
    for i, a in enumerate(PAGES):
        try:
            text = word.encode(a).decode("latin-1")
        except UnicodeEncodeError:
            continue
        for j, b in enumerate(PAGES):
            if j != i and (f := text.translate(_reading(b))) != word:
                out.setdefault(f, []).append(i * (len(PAGES) - 1) + j - (j > i))
    return out


def _latin_or_sign(text: str) -> bool:
    """Whether no character belongs to another script than Latin."""
    return all(ord(c) < 0x250 or 0x300 <= ord(c) < 0x370 or 0x1E00 <= ord(c) < 0x1F00 or 0x2000 <= ord(c) < 0x2C00 or ord(c) > 0xFFFF for c in text)


def _mapped(words: DataFrame, rows, schema: str) -> DataFrame:
    """A frame of what `rows` makes of (unit, n), in small steps, so that a batch's forms need little memory."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for b in batches:
            for at in range(0, len(b), 2000):
                out = [r for w, n in zip(b["unit"].values[at : at + 2000], b["n"].values[at : at + 2000]) for r in rows(w, n)]
                yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(names)})

    return words.select("unit", "n").mapInPandas(run, schema)


def _run_rows(w: str, n: int):
    if LOST not in w:
        sure = len(w) > 1 or _latin_or_sign(w)
        yield from ((f, w, n, sure) for f in run_forms(w))


def _back_rows(w: str, n: int):
    yield from ((f, w, n) for f in before_readings(w))


def _word_rows(w: str, n: int):
    yield from ((f, w, n) for f in word_forms(w) if not f.isspace())


def _pages_between(hit: DataFrame) -> DataFrame:
    """(form, original, n_original, n_form, pair): the pairs of pages that make a form of its original."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield b.assign(pair=pd.Series([word_forms(o).get(f, []) for f, o in zip(b["form"].values, b["original"].values)], index=b.index, dtype=object))

    d = hit.select("form", "original", "n_original", "n_form").mapInPandas(run, "form string, original string, n_original long, n_form long, pair array<int>")
    return d.withColumn("pair", F.explode("pair"))


def words_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): distinct words of each document with characters beyond ASCII, digits as one placeholder."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, "[0-9]+", "0")))
    return docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]")).select(key, found.alias("words"))


def _bad_runs(runs: DataFrame, n_tasks: int, ratio: float) -> DataFrame:
    """(form, original): runs that are garbled forms of runs of the corpus; original: the commonest one that is not itself garbled, or null."""
    runs = runs.repartition(n_tasks, "unit")
    # Hardly any run can be a reading of UTF-8, so this side is small and its size checked.
    back = checked(cut(_mapped(runs, _back_rows, "look string, form string, n_form long").select("look", "form", "n_form")), 160)
    table = _mapped(runs, _run_rows, "made string, word string, n long, sure boolean")
    hit = table.join(back, table["made"] == back["look"]).where((F.col("word") != F.col("form")) & (F.col("sure") | (F.col("n") >= ratio * F.col("n_form"))))
    hit = cut(hit.select("form", "word", "n").distinct())
    forms = hit.select(F.col("form").alias("word")).distinct()
    clean = hit.join(forms, "word", "left_anti").groupBy("form").agg(F.max_by("word", F.struct("n", "word")).alias("original"))
    return cut(hit.select("form").distinct().join(clean, "form", "left"))


def _bad_words(units: DataFrame, each: DataFrame, key: str, by_run: DataFrame, n_tasks: int, ratio: float, alone: float, together: int) -> DataFrame:
    """(word, original): words that are another word of the corpus in another page."""
    clean = units.where(~F.contains("word", F.lit(LOST))).join(by_run.select("word"), "word", "left_anti").select(F.col("word").alias("unit"), "n")
    clean = cut(clean.repartition(n_tasks, "unit"))
    table = _mapped(clean, _word_rows, "form string, original string, n_original long")
    hit = cut(table.join(checked(clean.select(F.col("unit").alias("form"), F.col("n").alias("n_form")), 96), "form"))
    often = F.when(F.char_length("form") > 1, ratio).otherwise(alone) * F.col("n_form")
    sure = hit.where((F.col("n_original") >= 2) & (F.col("n_original") >= often)).select("form", "original", "n_original")
    # By documents: words that go back by one pair of pages, none of them commoner than its original and together rarer.
    rare = (F.col("n_original") < F.greatest(often, F.lit(2))) & (F.col("n_original") >= F.col("n_form")) & (F.char_length("form") > 1)
    one = cut(_pages_between(hit.where(rare)))
    doc = each.select(key, F.explode("words").alias("form")).join(checked(one, 160), "form")
    words = F.collect_set(F.struct("form", "original", "n_original"))  # at most the distinct words of one document
    doc = doc.groupBy(key, "pair").agg(F.count_distinct("form").alias("_n"), F.sum("n_original").alias("_o"), F.sum("n_form").alias("_f"), words.alias("w"))
    linked = doc.where((F.col("_n") >= together) & (F.col("_o") > F.col("_f"))).select(F.explode("w").alias("w")).select("w.*").distinct()
    return sure.unionByName(linked).groupBy(F.col("form").alias("word")).agg(F.max_by("original", F.struct("n_original", "original")).alias("original"))


def garbled_words(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: float = 3.0, alone: float = 50.0, together: int = 3) -> tuple[DataFrame, DataFrame]:
    """(words of each document, bad: word, original or null, whole: whether nothing of the original is garbled)."""
    spark = docs.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    each = cut(words_of(docs, key, text))
    units = cut(each.distinct().select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))

    # Runs: UTF-8 read as a page. (Counted by words, weighted by documents.)
    per_word = units.select("word", "n", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)))).alias("unit"))
    bad_runs = _bad_runs(cut(per_word.groupBy("unit").agg(F.sum("n").alias("n"))), n_tasks, ratio)
    fixes = per_word.join(bad_runs, per_word["unit"] == bad_runs["form"]).groupBy("word").agg(F.collect_list(F.struct(F.col("form").alias("a"), F.col("original").alias("b"))).alias("fixes"))
    longest_first = F.sort_array(F.transform("fixes", lambda f: F.struct((-F.length(f["a"])).alias("k"), f["a"].alias("a"), f["b"].alias("b"))))
    mended = F.aggregate(longest_first, F.col("word"), lambda w, f: F.when(f["b"].isNull(), w).otherwise(F.replace(w, f["a"], f["b"])))
    by_run = fixes.select("word", F.nullif(mended, F.col("word")).alias("original"), F.forall("fixes", lambda f: f["b"].isNotNull()).alias("whole"))
    by_run = cut(by_run)

    by_word = _bad_words(units, each, key, by_run, n_tasks, ratio, alone, together).withColumn("whole", F.lit(True))
    bad = cut(by_run.unionByName(by_word.join(by_run.select("word"), "word", "left_anti")))

    # Lost characters: words of one rest are alike but for what was lost.
    rest = F.regexp_replace("word", RUN, LOST)
    lost = units.where(F.contains("word", F.lit(LOST))).select("word", rest.alias("rest"))
    good = units.where(~F.contains("word", F.lit(LOST))).join(bad.select("word"), "word", "left_anti").select(rest.alias("rest"), F.col("word").alias("original"))
    good = good.join(lost.select("rest").distinct(), "rest", "left_semi").groupBy("rest").agg(F.count("*").alias("_n"), F.max("original").alias("original"))
    lost = lost.join(good, "rest", "left").where(F.col("_n").isNotNull() | F.col("word").rlike(r"\p{L}\uFFFD|\uFFFD\p{L}"))
    by_loss = lost.select("word", F.when(F.col("_n") == 1, F.col("original")).alias("original"), (F.col("_n") == 1).alias("whole"))
    bad = cut(bad.unionByName(by_loss.join(bad.select("word"), "word", "left_anti")))

    # An original that is itself a garbled word gives way to its own.
    again = bad.select(F.col("word").alias("original"), F.col("original").alias("_next"), F.col("whole").alias("_whole"))
    for _ in range(DEPTH - 1):
        bad = bad.join(again, "original", "left").select("word", F.coalesce("_next", "original").alias("original"), (F.coalesce("whole", F.lit(False)) & F.coalesce("_whole", F.lit(True))).alias("whole"))
    bad = bad.join(again.select("original", F.lit(True).alias("_bad")), "original", "left")
    return each, cut(bad.select("word", "original", (F.col("whole") & F.col("original").isNotNull() & F.col("_bad").isNull()).alias("whole")))


def _checked(small: DataFrame) -> DataFrame:
    """small, marked for broadcast if its counted size is bounded."""
    size = small.agg(F.sum(F.octet_length("word") + F.coalesce(F.octet_length("original"), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: float = 3.0, alone: float = 50.0, together: int = 3) -> DataFrame:
    """(key, words): the documents with garbled text, and how many distinct words of theirs are garbled."""
    each, bad = garbled_words(docs, key, text, ratio, alone, together)
    hits = each.select(key, F.explode("words").alias("word")).join(_checked(bad), "word")
    return hits.groupBy(key).agg(F.count_distinct("word").alias("words"))


def restored(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: float = 3.0, alone: float = 50.0, together: int = 3) -> DataFrame:
    """(key, restored, left): the affected documents with verified originals in place, and how many distinct words of theirs stay garbled, wholly or in part."""
    each, bad = garbled_words(docs, key, text, ratio, alone, together)
    hits = each.select(key, F.explode("words").alias("word")).join(_checked(bad), "word").select(key, "word", "original", "whole").distinct()
    fixes = hits.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("word", "original")))).alias("fixes"), F.count_if(~F.col("whole")).alias("left")
    )
    kind = dict(docs.dtypes)[key]

    def run(batches):
        import re

        word, digits = re.compile(WORD.replace("*+", "*")), re.compile("[0-9]+")

        def fix(fixes: dict[str, str]):
            def one(m: re.Match) -> str:
                have = digits.findall(m[0])
                new = fixes.get(digits.sub("0", m[0]))
                if new is None or new.count("0") != len(have):
                    return m[0]
                left = iter(have)
                return re.sub("0", lambda _: next(left), new)

            return one

        for b in batches:
            b["restored"] = [word.sub(fix(dict(f)), t) for t, f in zip(b["text"], b["fixes"])]
            yield b[["key", "restored", "left"]]

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull()).dropDuplicates(["key"])
    rows = rows.join(fixes.withColumnRenamed(key, "key"), "key")
    return rows.mapInPandas(run, f"key {kind}, restored string, left long").withColumnRenamed("key", key)
