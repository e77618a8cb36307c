"""Quality rules with cross-document line frequency (operator 10, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

# White space that ends a word, signs that count as symbols.
SPACE, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, trimmed, runs of white space as one space; null for a line without a word."""
    return F.when(line.rlike(WORD), F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))))


def _repeated(places: Column) -> Column:
    """Words covered by windows that start at these sorted places."""
    return F.aggregate(F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words (long) and base_failed; null texts have no words.

    Windows of five words meet through a sort of their 64-bit hashes within the text, so a text of n words costs
    n log n; only texts with an equal pair are sorted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size("__words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("__words", _words(t)).withColumn("__lines", lines)
    out = out.withColumn("__hash", F.transform("__words", lambda x: F.xxhash64(x)))
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("__hash", i + k) for k in range(WINDOW))))
    out = out.withColumn("__h", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    ordered = F.array_sort(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("__at", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), ordered))
    twins = F.zip_with("__at", F.slice("__at", 2, F.size("__at")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("__places", F.when(F.col("__at").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))))
    out = out.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated(F.col("__places")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def line_table(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """(row, host, key, no, line, n): the lines with a word of each document, by number, hash of the normalised line and words.

    row: 128 bits that name equal rows; its first half is a hash of the text alone.
    """
    t = F.col(text)
    each = docs.where(t.isNotNull()).select(_row(text, host, key).alias("row"), F.col(host).alias("host"), F.col(key).alias("key"), F.posexplode(F.split(t, "\n")).alias("no", "text"))
    return each.select("row", "host", "key", "no", line_key(F.col("text")).alias("line"), F.regexp_count("text", F.lit(WORD)).alias("n")).where("line is not null")


def _row(text: str, host: str, key: str) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(key, host, text).alias("b"))


def frequent_lines(lines: DataFrame, least: int = 20) -> DataFrame:
    """(host, line, first): normalised lines of ``line_table`` that more than ``least`` documents of a host have.

    Equal texts count as one document: a group of copies, which near-dedup reduces to one, does not make all its lines
    frequent. ``first`` is the smallest key of a document that has the line.
    """
    found = lines.groupBy("host", "line").agg(F.count_distinct("row.a").alias("n"), F.min("key").alias("first"))
    return found.where(F.col("n") > least).select(F.col("host").alias("of"), F.col("line").alias("common"), "first")


def quality(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", least: int = 20, left: float = 0.2) -> DataFrame:
    """docs with the base counts, ``removed`` (numbers of the lines above the limit), ``kept_words`` and ``kept``.

    A line that ``frequent_lines`` names goes from every document of its host but the first one that has it. A document
    is rejected if it fails the base rules or keeps under ``left`` of its words. Null texts have no words and fail; a
    null host is a host of its own; repeated rows are one document; an empty table gives an empty one; other columns
    stay (a column named like an added one raises ValueError).

    Lines meet the frequent ones in a join by host and line, so neither side need be small, and what goes meets the documents by the rows' hash;
    the counts are made before that join, so a text that is not asked for is not shuffled.
    """
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "kept_words", "kept"}
    if both := added & set(docs.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    scratch = Scratch(docs.sparkSession, "quality")
    lines = scratch.save(line_table(docs, text, host, key), "lines")
    found = scratch.save(frequent_lines(lines, least), "frequent")
    met = lines.join(found, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("common"))).where(~F.col("key").eqNullSafe(F.col("first")))
    gone = scratch.save(met.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("no", "n"))).alias("gone")), "gone")
    base = base_counts(docs, text).withColumn("__row", _row(text, host, key))
    # a fence: a filter on the verdict would else be pushed below the projections, and each array in it
    # computed again for every element of the next
    base = base.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in base.columns)))))
    base = base.join(gone.withColumnRenamed("row", "__of"), F.col("__row") == F.col("__of"), "left").drop("__row", "__of")
    lost = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda s, x: s + x["n"]), F.lit(0))
    base = base.withColumn("removed", F.coalesce(F.transform("gone", lambda x: x["no"]), F.array().cast("array<int>")))
    base = base.withColumn("kept_words", F.col("n_words") - lost).drop("gone")
    return base.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= left * F.col("n_words")))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the \\n-split lines of these numbers."""
    lines = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) > 0, F.array_join(lines, "\n")).otherwise(text)
