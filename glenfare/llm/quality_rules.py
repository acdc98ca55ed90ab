"""Quality rules (operator 3): thresholds that adapt to language and source.

Every document gets four signals as whole numbers on a fixed grid of ``STEPS``
steps (``SIGNALS``).  The mergeable quantile sketch of a group is its histogram on
that grid: STEPS + 1 counters at most, which add up, in any order, to the same
sketch, and a quantile is known to one grid step.  Sketches of (lang, source) merge
to those of a language and of the whole table.

Word length has the thresholds q25 - SPREAD * (q75 - q25) and q75 + SPREAD * (q75 - q25)
(a spread of one step at least), the other signals SPREAD steps above their tail quantile.
Thresholds of a group are shrunk towards those of its language, and these towards
those of the whole table, as if the wider one had been seen in PRIOR documents: a
large source is judged by itself, one of a few documents nearly as its language,
by the same rule at every size.  A document stays if all its signals keep to
the thresholds of its group.

All of it is column expressions, partial aggregation and joins on tables with
one row for each group; a hot source costs one row for each task and grid step.

Edge cases: null or empty text has no words and fails the base rule; null lang
or source is a group of its own; ties cannot matter, as thresholds are values;
repeated rows count as often as they occur; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glenfare.llm.common import let, rows_in, stored, table, text_key
from glenfare.plans.joins import attach_scalars

#: Fixed values of the contract.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Repeated windows up to which each is looked up; beyond, windows are sorted.
LOOKUP_WINDOWS = 32

#: Steps of a signal's grid; what lies beyond the last counts as the last.
STEPS = 1000
#: Parameters of the adaptive rules: signal -> (grid steps for 1.0, percent of texts up to the tail quantile).
#: Word length varies in every text: quartiles. Symbols come in junk only: what nine of ten texts have is
#: common. Good texts repeat lines and words too, some of them much: only the last hundredth is odd.
SIGNALS = {"word_len": (10, 75), "symbol_rate": (1000, 90), "dup_line_rate": (1000, 99), "repeat_rate": (1000, 99)}
SPREAD = 4
#: Documents that the wider group's thresholds count for.
PRIOR = 100


def words_of(text: Column) -> Column:
    """The words of ``text`` as an array: runs of ASCII white space separate
    them.  A text without words gives one empty string."""
    return F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\t-\r]+")


def window_hashes(words: Column) -> Column:
    """The hash of each 3-word window, by its place."""
    triple = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    return F.slice(triple, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def covered(places: Column) -> Column:
    """Words that windows at these ascending places cover: 3 each, less the overlaps."""
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x))


def repeated_words(words: Column) -> Column:
    """Words inside some 3-word window that the text has twice or more.

    Most texts repeat no window, which a hash set of the windows tells.  A few
    repeated windows are looked up one by one; many are found by sorting all
    windows with their places, where equal neighbours mark the repeated ones."""
    def by_lookup(h: Column, repeated: Column) -> Column:
        return let(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.transform(
            F.filter(s, lambda e: F.array_contains(repeated, e["x"])), lambda e: e["i"]))

    def by_sort(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.sort_array(let(placed, lambda s: F.array_compact(F.transform(s, lambda e, k: F.when(
            F.get(s, k - 1)["x"].eqNullSafe(e["x"]) | F.get(s, k + 1)["x"].eqNullSafe(e["x"]), e["i"])))))

    def twice(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(
            s, lambda x, k: F.get(s, k - 1).eqNullSafe(x))))

    def count(h: Column) -> Column:
        return covered(let(twice(h), lambda r: F.when(F.size(r) <= LOOKUP_WINDOWS, by_lookup(h, r))
                           .otherwise(by_sort(h))))

    return let(window_hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(h)))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    def count(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
        return let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(F.split(text, "\n"), lambda x: F.when(
        F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(count(x)))


def symbols(text: Column) -> Column:
    """Characters of SYMBOLS; a text that has none is only searched."""
    found = F.lit(False)
    for c in SYMBOLS:
        found = found | text.contains(c)
    return F.when(found, F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))).otherwise(0)


def base_signals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, source and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = docs.select(
        "doc_id", text_key("lang", "source").alias("text_key"), "lang", "source", symbols(text).cast("long").alias("n_symbols"),
        repeated_lines(text).cast("long").alias("n_dup_lines"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        let(words_of(text), lambda w: F.struct(
            F.when(w[0] == "", 0).otherwise(F.size(w)).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"))).alias("_w"))
    n, r = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    return wide.select("doc_id", "text_key", "lang", "source", n.alias("n_words"), "_w.word_chars", "n_symbols", "n_dup_lines",
                       r.alias("n_repeat_words"), "n_lines",
                       ((n < MIN_WORDS) | (100 * r > 50 * n)).alias("base_failed"))


def on_grid(df: DataFrame) -> DataFrame:
    """``df`` with ``g_<signal>``: each signal in whole grid steps, rounded down."""
    def ratio(a: str, b: str, signal: str) -> Column:
        return F.coalesce(F.expr(f"least({a} * {SIGNALS[signal][0]} div nullif({b}, 0), {STEPS})"), F.lit(0))
    return df.withColumns({
        "g_word_len": ratio("word_chars", "n_words", "word_len"),
        "g_symbol_rate": ratio("n_symbols", "word_chars", "symbol_rate"),
        "g_dup_line_rate": ratio("n_dup_lines", "n_lines", "dup_line_rate"),
        "g_repeat_rate": ratio("n_repeat_words", "n_words", "repeat_rate")})


def sketches(df: DataFrame) -> DataFrame:
    """(lang, source, signal, step, n): the sketch of every group, of documents that pass the base rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"g_{s}").alias("step")) for s in SIGNALS]))
    return (df.filter("NOT base_failed").select("lang", "source", pairs.alias("p"))
            .groupBy("lang", "source", "p.signal", "p.step").agg(F.count(F.lit(1)).alias("n")))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "signal", "step").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: the keys, ``size`` (documents) and its own thresholds ``t_<signal>`` and ``t_word_len_low``."""
    by = [*keys, "signal"]
    run = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sketch.withColumns({"upto": F.sum("n").over(run), "size": F.sum("n").over(Window.partitionBy(*by))})

    def reached(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("size"), F.col("step")))
    q = at.groupBy(*by).agg(F.first("size").alias("size"), *[
        reached(p).alias(f"q{p}") for p in sorted({25, 75, *[tail for _, tail in SIGNALS.values()]})])
    way = SPREAD * F.greatest(F.col("q75") - F.col("q25"), F.lit(1))
    own = {f"t_{s}": F.when(F.col("signal") == s, F.col(f"q{tail}") + (way if s == "word_len" else SPREAD))
           for s, (_, tail) in SIGNALS.items()}
    own["t_word_len_low"] = F.when(F.col("signal") == "word_len", F.col("q25") - way)
    return q.groupBy(*keys).agg(F.max("size").alias("size"), *[F.max(c).alias(t) for t, c in own.items()])


def shrunk(narrow: DataFrame, wide: DataFrame, on: list[str]) -> DataFrame:
    """``narrow`` with its thresholds drawn towards those of the wider group, PRIOR documents of it, rounded down."""
    names = [c for c in wide.columns if c.startswith("t_")]
    w = wide.select(*[F.col(k).alias(f"_{k}") for k in on], *[F.col(t).alias(f"_{t}") for t in names])
    if on:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on]
        both = narrow.join(w, reduce(and_, same))
    else:
        both = attach_scalars(narrow, w)
    return both.select(*[c for c in narrow.columns if c not in names], *[
        F.floor((F.col("size") * F.col(t) + PRIOR * F.col(f"_{t}")) / (F.col("size") + PRIOR)).alias(t) for t in names])


def thresholds(df: DataFrame) -> DataFrame:
    """(lang, source, size, thresholds): one row for each group with a document that passes the base rule."""
    fine = stored(sketches(df), "quality-sketches")
    lang_sketch = stored(merged(fine, ["lang"]), "quality-lang-sketches")
    whole = limits(merged(lang_sketch.withColumn("one", F.lit(1)), ["one"]), ["one"]).drop("one")
    by_lang = shrunk(limits(lang_sketch, ["lang"]), whole, [])
    return stored(shrunk(limits(fine, ["lang", "source"]), by_lang, ["lang"]), "quality-thresholds")


def judged(docs: DataFrame) -> DataFrame:
    """The base columns, the threshold of each signal (null in a group whose texts all fail the base rule) and ``kept``."""
    df = stored(on_grid(base_signals(docs)), "quality-signals")  # one narrow row for each document
    groups = thresholds(df).drop("size").withColumnsRenamed({"lang": "s_lang", "source": "s_source"})
    joined = df.join(groups, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")),
                     "left").drop("s_lang", "s_source")
    fits = ~F.col("base_failed") & (F.col("g_word_len") >= F.col("t_word_len_low"))
    for s in SIGNALS:
        fits = fits & (F.col(f"g_{s}") <= F.col(f"t_{s}"))
    return joined.withColumn("kept", F.coalesce(fits, F.lit(False)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[f"t_{s}" for s in SIGNALS], "t_word_len_low")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return rows_in(docs, judged(docs).filter("kept").select(F.col("doc_id").cast("long"), "text_key"),
                   "lang", "source")


QUERIES = {"op3_quality_rules": op3_quality_rules}
