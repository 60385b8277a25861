"""Operator 7 (native): quality rules with cross-document line frequency.

Lines are normalised (lower case, runs of white space as one space, digits as 0),
hashed, and counted per host as the number of *distinct texts* that hold them, so
exact copies of one document count once.  A line in more than ``max_docs`` texts of
its host is repeated boilerplate: it is removed everywhere but in the first document
of the host that holds it.  A document that keeps less than ``min_kept_percent`` of
its words is depleted and rejected, besides those that fail the base rules.

Everything is DataFrame functions.  Per-document counts come from one pass over the
text without a shuffle; only line hashes are shuffled, pre-aggregated first, so one
line, host or text holding a third of all rows costs one partial row per task.

Defined cases: null text or source (null is a host of its own), empty and blank texts
(0 words: base_failed), repeated rows and null doc_ids (each row gets its result),
empty tables (empty result), extra columns of any name (ignored).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, table, words

#: Limits: distinct texts of a host that may hold a line; words in per cent that must remain.
MAX_DOCS = 10
MIN_KEPT_PERCENT = 20
#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " ")), "[0-9]", "0")


def with_repeated_words(d: DataFrame, w: str) -> DataFrame:
    """Adds n_repeat_words: words of the list ``w`` inside 3-word windows that occur twice or more in it.

    Windows are sorted as (hash, position); equal neighbours are repeats.  Their
    positions sorted again, window i covers min(3, distance to the repeat before) new
    words.  Each step is a column of its own, so no lambda computes a list anew.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    d = d.withColumn("_h", hashes)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_h") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("i")),
    )
    d = d.withColumn("_sorted", F.when(F.size("_h") > 3, F.sort_array(windows)))
    repeats = F.filter(
        "_sorted",
        lambda x, k: ((k > 0) & (F.get("_sorted", k - 1)["h"] == x["h"])) | (F.get("_sorted", k + 1)["h"] == x["h"]),
    )
    d = d.withColumn("_at", F.sort_array(F.transform(repeats, lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["words"] + F.least(F.lit(3), i - a["last"])).alias("words"), i.alias("last")),
        lambda a: a["words"],
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_sorted", "_at")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, key and the base counts of each row; no shuffle."""
    d = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text")))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = with_repeated_words(d, "w")
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    counts = F.struct(
        "doc_id",
        "host",
        document_key().alias("key"),
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    # filters on the counts stay above this: pushed below, they would put the sort into each lambda call
    return d.select(F.inline(F.array(counts))).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def document_key() -> Column:
    """Rows alike in doc_id, host and text share it; they also share every result."""
    return F.xxhash64(F.col("doc_id"), F.col("host"), F.coalesce(F.col("text"), F.lit("")))


def document_lines(docs: DataFrame) -> DataFrame:
    """Every line with a word of every document: position, hash of the normalised line, words."""
    d = docs.select("doc_id", F.col("source").alias("host"), "text").where("text IS NOT NULL")
    lines = d.select(
        "doc_id", "host", document_key().alias("key"), F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).where(F.col("line").rlike(WORD))
    return lines.select(
        "doc_id", "host", "key", "text_hash", "pos",
        F.xxhash64(normalised(F.col("line"))).alias("line_hash"),
        F.size(words(F.col("line"))).cast("long").alias("line_words"),
    )


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines above the limit: host, line_hash, n_docs and the first document that holds them."""
    per_text = lines.groupBy("host", "line_hash", "text_hash").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    per_line = per_text.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    return per_line.where(F.col("n_docs") > max_docs)


def removed_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, key, the hashes of the lines to remove and the words they hold, for documents that lose any."""
    lines = document_lines(docs)
    f = frequent_lines(lines, max_docs).select(
        F.col("host").alias("f_host"), F.col("line_hash").alias("f_hash"), F.col("first.key").alias("first_key")
    )
    hit = lines.join(
        f, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line_hash") == F.col("f_hash")) & (F.col("key") != F.col("first_key"))
    )
    return (
        hit.dropDuplicates(["doc_id", "key", "pos"])  # rows alike share one key: their lines count once
        .groupBy("doc_id", "key")
        .agg(F.sum("line_words").alias("removed_words"), F.collect_set("line_hash").alias("hashes"))
    )


def judged(docs: DataFrame, max_docs: int = MAX_DOCS, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """Base counts, the words of removed lines, their hashes, and the verdict of each row."""
    base = base_counts(docs)
    gone = removed_lines(docs, max_docs).select(
        F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), F.col("removed_words").alias("g_words"), "hashes"
    )
    j = base.join(gone, (F.col("key") == F.col("g_key")) & F.col("doc_id").eqNullSafe(F.col("g_id")), "left")
    removed = F.coalesce("g_words", F.lit(0)).cast("long")
    return j.select(
        *base.columns,
        removed.alias("removed_words"),
        "hashes",
        (~F.col("base_failed") & (100 * (F.col("n_words") - removed) >= min_kept_percent * F.col("n_words"))).alias("kept"),
    )


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept rows with all their columns, repeated lines removed from the text, n_chars to match."""
    verdict = judged(docs).where("kept").select(
        F.col("doc_id").alias("v_id"), F.col("key").alias("v_key"), F.coalesce("hashes", F.array().cast("array<bigint>")).alias("v_gone")
    ).dropDuplicates(["v_id", "v_key"])
    cols = docs.columns
    row = docs.select(F.struct(*cols).alias("row"), "doc_id", F.col("source").alias("host"), "text").withColumn("key", document_key())
    j = row.join(verdict, (F.col("key") == F.col("v_key")) & F.col("doc_id").eqNullSafe(F.col("v_id")))
    kept_lines = F.filter(
        F.split("text", "\n"), lambda x: ~x.rlike(WORD) | ~F.array_contains(F.col("v_gone"), F.xxhash64(normalised(x)))
    )
    text = F.when(F.size("v_gone") == 0, F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    j = j.withColumn("new_text", text)
    out = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in cols else None}
    return j.select(*[(out[c] if c in out else F.col("row")[c]).alias(c) for c in cols])
