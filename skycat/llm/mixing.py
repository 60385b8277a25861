"""Operator 8: mixing sources to target weights by systematic sampling.

Targets: the sources' weights share ``share`` of all words; a target stops at
``max_copies`` times its source's size and the excess is shared again by weight.
The fixed point is a water level: with sources ordered by (cap / weight), the capped
ones are a prefix and the others get weight x level.  It is found with prefix sums
over one row per source.

Draw: each document of a source expects e = target / source size copies.  Documents
of a source are ordered by size, then by a hash of doc_id, so the draw is spread over
all sizes; with document r of the source and one random offset u per source, copies =
floor(e*r + u) - floor(e*(r-1) + u): once per integer boundary crossed.

The ranks come from counts, never from one window over a source: rows are numbered
inside (source, size, 1/256 of the hash range), whose start is a running sum of
counts over sizes and then over hash ranges.  A source holding a third of all rows is
so dealt over its sizes times 256 groups.

Defined cases: null text (size 0), null source (a source, ordered last), a source
without words (target 0, taken 0), repeated rows and null doc_ids (rows of their own),
empty tables (empty result), extra columns (kept by ``mixed``, ignored by the query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words

#: Weights by source in code-point order, repeating; the share of all words; the most copies of a document.
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a string (52 bits, so exact as a double)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _sized(docs: DataFrame) -> DataFrame:
    """The row's columns as they came, numbered, with size, the hash that orders it and its hash range.

    The columns stay apart, so those that the caller does not read (the text) are not shuffled.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.select(
        *[F.col(c).alias(f"col_{i}") for i, c in enumerate(docs.columns)],
        F.col("doc_id").alias("id"),
        F.col("source").alias("src"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        h.alias("h"),
    ).withColumn("range", F.substring("h", 1, 2))


def targets(counts: DataFrame, max_copies: int = MAX_COPIES, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """One row per source: its size, target, expected copies and offset.  ``counts``: src, source_size."""
    # one row per source of the mix: the windows below read only those rows
    w = Window.orderBy(F.col("src").asc_nulls_last())
    s = counts.withColumn("no", F.row_number().over(w)).withColumn(
        "weight", F.get(F.array(*[F.lit(x) for x in weights]), (F.col("no") - 1) % len(weights)).cast("long")
    )
    s = s.withColumn("cap", max_copies * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_level), F.lit(0)))
    s = s.withColumn("weight_before", F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weights", F.sum("weight").over(every))
    # the level with the sources before capped; valid if this source is not above its cap. The first valid one is the
    # largest: capping a source that is below its cap lowers the level.
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weights") - F.col("weight_before"))
    s = s.withColumn("level", F.max(F.when(level <= F.col("cap") / F.col("weight"), level)).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return s.select(
        "src",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target / F.col("source_size")).alias("e"),
        _unit(F.concat(F.lit(seed + ":"), F.col("no").cast("string"))).alias("u"),
    )


def drawn(docs: DataFrame, max_copies: int = MAX_COPIES, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Each row as struct ``row`` with size, source_size, target and copies."""
    d = _sized(docs)
    # counts by (source, size, hash range): narrow rows; all sums read the one shuffle that makes them
    counts = d.groupBy("src", "size", "range").agg(F.count("*").alias("n"))
    by_size = counts.groupBy("src", "size").agg(F.sum("n").alias("n"))
    per_source = by_size.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    t = targets(per_source, max_copies, weights, seed)
    sizes = by_size.withColumn(
        "size_start", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    ranges = counts.withColumn(
        "range_start", F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    starts = _join(_join(ranges, sizes, ["src", "size"]), t, ["src"])
    ranked = d.withColumn("nth", F.row_number().over(Window.partitionBy("src", "size", "range").orderBy("h", "id")))
    j = _join(ranked, starts, ["src", "size", "range"])
    r = F.col("size_start") + F.col("range_start") + F.col("nth")
    copies = F.floor(F.col("e") * r + F.col("u")) - F.floor(F.col("e") * (r - 1) + F.col("u"))
    row = F.struct(*[F.col(f"col_{i}").alias(c) for i, c in enumerate(docs.columns)])
    return j.select(row.alias("row"), "size", "source_size", "target", copies.cast("int").alias("copies"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null; the keys once."""
    r = right.select(*[F.col(k).alias(f"r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"r_{k}"))
        on = c if on is None else on & c
    return left.join(r, on).drop(*[f"r_{k}" for k in keys])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: every row as often as it is drawn, with all its columns."""
    d = drawn(docs, **options).where("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select(
        *[F.col("row")[c].alias(c) for c in docs.columns]
    )


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawn(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    # copies once in a select of its own: only then does Spark see that doc_id is all that is read of the row
    d = d.select(F.col("row")["doc_id"].alias("doc_id"), "size", "source_size", "target", "copies")
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
