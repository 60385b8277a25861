"""A raw sky catalogue derived from the driver's ``lineitem`` table.

The driver's tables hold no sky positions, so each lineitem row becomes one
raw catalogue row (D1 + file name + identity) by hash-based expressions that
mean the same in Spark and DuckDB.  Its size grows with lineitem, and it
carries the edge cases the pipeline must handle: z below and above the cut,
NaN ra, infinite dec, negative weights, redshifts slightly past each tracer's
nominal range.

    id        l_orderkey|l_partkey|l_suppkey|l_linenumber|round(price*100)
    file_name MANIFEST[h('cat') mod 10]
    ra        u('ra') * 360              (NaN when 0.02 <= bad < 0.03)
    dec       u('dec') * 180 - 90        (+inf when 0.03 <= bad < 0.04)
    z         0.0005 when bad < 0.01; 6 when bad < 0.02; else per tracer
    weight    float(l_quantity / 25 - 0.06)
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.functions.hashing import hash52, hash52_sql, salted_text, uniform, uniform_sql
from skycat.functions.sqltext import dlit, slit
from skycat.schema import DEFAULT_TRACER, MANIFEST, TRACER_PREFIXES

# Per-tracer redshift generator (offset, span): reaches a little past each
# tracer's nominal range on purpose, so that validation has work to do.
Z_GEN = {0: (0.01, 0.64), 1: (0.4, 0.75), 2: (0.8, 0.85), 3: (0.8, 1.35)}


def _tracer_of(file_name: str) -> int:
    return next((t for p, t in TRACER_PREFIXES if file_name.startswith(p)), DEFAULT_TRACER)


# Tracer of each manifest entry (P1 applied to the file names, in order).
MANIFEST_TRACERS = [_tracer_of(m) for m in MANIFEST]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def raw_catalog(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The raw catalogue of ``sf_dir``, written once per session as Parquet.

    It plays the part of the raw input files: later cuts scan plain columns
    and push their predicates into the Parquet reader.  See ``derive_raw``.
    """
    if not materialize:
        return derive_raw(spark, sf_dir)
    from skycat.sources.tables import fingerprint, materialized

    key = f"raw-catalog-{fingerprint(spark, table_path(sf_dir, 'lineitem'))}"
    return materialized(spark, key, lambda: derive_raw(spark, sf_dir))


def derive_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns: id, file_name, RA, DEC, Z (double), WEIGHT (float).

    Each derived column references each hash once (array lookups by manifest
    index rather than CASE chains over the file name): a quality cut pushed
    below this projection inlines the definitions, so repeated references
    would multiply the md5 work per row.
    """
    li = spark.read.parquet(table_path(sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"
    )
    ident = F.concat_ws(
        "|",
        F.col("l_orderkey").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.round(F.col("l_extendedprice") * F.lit(100)).cast("bigint").cast("string"),
    )
    df = li.select("l_quantity", ident.alias("id"))
    df = df.withColumns(
        {
            "_idx": (hash52(salted_text("cat", F.col("id"))) % len(MANIFEST) + 1).cast("int"),
            "_bad": uniform("bad", F.col("id"), "md5"),
        }
    )
    off = F.array(*[F.lit(Z_GEN[t][0]) for t in MANIFEST_TRACERS])
    span = F.array(*[F.lit(Z_GEN[t][1]) for t in MANIFEST_TRACERS])
    bad = F.col("_bad")
    return df.select(
        "id",
        F.element_at(F.array(*[F.lit(m) for m in MANIFEST]), F.col("_idx")).alias("file_name"),
        F.when((bad >= 0.02) & (bad < 0.03), F.lit(float("nan")))
        .otherwise(uniform("ra", F.col("id"), "md5") * F.lit(360.0))
        .alias("RA"),
        F.when((bad >= 0.03) & (bad < 0.04), F.lit(float("inf")))
        .otherwise(uniform("dec", F.col("id"), "md5") * F.lit(180.0) - F.lit(90.0))
        .alias("DEC"),
        F.when(bad < 0.01, F.lit(0.0005))
        .when(bad < 0.02, F.lit(6.0))
        .otherwise(F.element_at(off, F.col("_idx")) + uniform("z", F.col("id"), "md5") * F.element_at(span, F.col("_idx")))
        .alias("Z"),
        (F.col("l_quantity") / F.lit(25) - F.lit(0.06)).cast("float").alias("WEIGHT"),
    )


def raw_catalog_sql() -> str:
    """DuckDB twin of ``raw_catalog`` (a SELECT over the ``lineitem`` view)."""
    ident = (
        "concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
        "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))"
    )
    manifest = "[" + ", ".join(slit(m) for m in MANIFEST) + "]"
    off = "[" + ", ".join(dlit(Z_GEN[t][0]) for t in MANIFEST_TRACERS) + "]"
    span = "[" + ", ".join(dlit(Z_GEN[t][1]) for t in MANIFEST_TRACERS) + "]"
    return f"""
SELECT id, {manifest}[_idx] AS file_name,
  CASE WHEN _bad >= 0.02 AND _bad < 0.03 THEN CAST('NaN' AS DOUBLE)
       ELSE {uniform_sql('ra', 'id')} * {dlit(360.0)} END AS RA,
  CASE WHEN _bad >= 0.03 AND _bad < 0.04 THEN CAST('Infinity' AS DOUBLE)
       ELSE {uniform_sql('dec', 'id')} * {dlit(180.0)} - {dlit(90.0)} END AS DEC,
  CASE WHEN _bad < 0.01 THEN {dlit(0.0005)} WHEN _bad < 0.02 THEN {dlit(6.0)}
       ELSE {off}[_idx] + {uniform_sql('z', 'id')} * {span}[_idx] END AS Z,
  CAST(l_quantity / 25 - {dlit(0.06)} AS FLOAT) AS WEIGHT
FROM (
  SELECT *, CAST({hash52_sql("'cat:' || id")} % {len(MANIFEST)} + 1 AS INTEGER) AS _idx,
         {uniform_sql('bad', 'id')} AS _bad
  FROM (SELECT l_quantity, {ident} AS id FROM lineitem)
)
"""
