"""Registered queries over the lineitem-derived catalogue, each with its
DuckDB SQL twin (the driver's correctness oracle).

Every query reads the whole ``lineitem`` table (through ``raw_catalog``) and
grows with it.  Spark side: ``QUERIES[name](spark, sf_dir) -> DataFrame``.
SQL side: ``SQL[name]`` runs on DuckDB with the driver's views registered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.functions.catalog import (
    catalog_label_sql,
    decode_z,
    decode_z_sql,
    encode_z,
    encode_z_sql,
    format_count_sql,
    format_z_range_sql,
    output_name_sql,
    quality_mask,
    quality_mask_sql,
    tracer_id_sql,
)
from skycat.functions.coords import sky_to_cartesian_sql
from skycat.functions.cosmology import comoving_distance_sql
from skycat.functions.hashing import uniform_sql
from skycat.functions.sqltext import dlit, slit
from skycat.operators import sampling, summary, view
from skycat.operators.dims import tracer_name_sql
from skycat.operators.ingest import process_catalog
from skycat.plans.derived import raw_catalog, raw_catalog_sql, table_path
from skycat.schema import (
    COSMOLOGY_MODEL,
    DEFAULT_OPACITY,
    DEFAULT_POINT_SIZE,
    H0,
    MANIFEST,
    OM0,
    RANDOM_SPREAD,
    SAMPLE_SEED,
    SCENE_MAX_POINTS,
    TARGET_PER_TRACER,
    TRACERS,
)
from skycat.sources import packed
from skycat.sources.tables import fingerprint, path_exists, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# Shared building blocks
# ---------------------------------------------------------------------------


def process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on the derived catalogue: D2 columns + catalog + id (computed)."""
    return process_catalog(raw_catalog(spark, sf_dir), keep=("id",))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed catalogue as later stages see it: written once by E1
    (K2, Parquet/zstd, in curve order) and scanned back (S4), as the original pipeline hands
    over between its steps.  Downstream filters then reach the Parquet reader
    instead of being inlined into the distance expression."""
    from skycat.operators.layout import curve_ordered
    from skycat.sources.tables import materialized

    @cache
    def rows() -> int:
        """Of the raw catalogue, from its Parquet footers; the cut only takes some away."""
        return raw_catalog(spark, sf_dir).count()

    return materialized(
        spark, f"processed-{_input(spark, sf_dir)}", lambda: curve_ordered(process(spark, sf_dir), rows=rows()), rows=rows
    )


def _input(spark: SparkSession, sf_dir: str) -> str:
    """Names the input in the keys of what is derived from it: changed files give another name."""
    return fingerprint(spark, table_path(sf_dir, "lineitem"))


def _processed_sql() -> str:
    x, y, zc = sky_to_cartesian_sql("RA", "DEC", "_dist")
    return f"""
SELECT CAST(RA AS FLOAT) AS ra, CAST(DEC AS FLOAT) AS dec, CAST(Z AS FLOAT) AS z,
       CAST({x} AS FLOAT) AS x, CAST({y} AS FLOAT) AS y, CAST({zc} AS FLOAT) AS z_cart,
       WEIGHT AS weight, {tracer_id_sql('file_name')} AS tracer,
       {catalog_label_sql('file_name')} AS catalog, id
FROM (SELECT *, {comoving_distance_sql('Z')} AS _dist
      FROM ({raw_catalog_sql()}) raw
      WHERE {quality_mask_sql()}) cut
"""


RAW_CTE = f"raw AS ({raw_catalog_sql()})"
PROCESSED_CTE = f"processed AS ({_processed_sql()})"


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------------------
# ingest
# ---------------------------------------------------------------------------


@register(
    "catalog_summary",
    with_ctes(
        f"""
SELECT {catalog_label_sql('file_name')} AS catalog,
       {tracer_name_sql(tracer_id_sql('file_name'))} AS tracer,
       n_galaxies, {format_count_sql('n_galaxies')} AS galaxies,
       z_min, z_max, {format_z_range_sql('z_min', 'z_max')} AS z_range,
       {output_name_sql('file_name')} AS output
FROM (SELECT file_name,
             count(CASE WHEN {quality_mask_sql()} THEN 1 END) AS n_galaxies,
             min(CASE WHEN {quality_mask_sql()} THEN CAST(Z AS FLOAT) END) AS z_min,
             max(CASE WHEN {quality_mask_sql()} THEN CAST(Z AS FLOAT) END) AS z_max
      FROM raw GROUP BY file_name) agg
""",
        RAW_CTE,
    ),
)
def q_catalog_summary(spark, sf_dir):
    """A1 (+P1, P3, P5, P14): the per-file processing summary."""
    raw = raw_catalog(spark, sf_dir)
    return summary.catalog_summary(raw, keep=quality_mask())


@register("processed_catalog", with_ctes("SELECT * FROM processed", PROCESSED_CTE))
def q_processed_catalog(spark, sf_dir):
    """E1 rows: P1, P3, P4, P5, P6, P7 over every raw row."""
    return process(spark, sf_dir)


def fits_root(spark: SparkSession, sf_dir: str) -> str:
    """A shared folder with the raw catalogue as FITS files, in two parts, written once for this input."""
    from skycat.plans.fixtures import write_fits_catalogs

    root = scratch_path(spark, f"fits-{_input(spark, sf_dir)}")
    raw = raw_catalog(spark, sf_dir)
    late = F.crc32("id") % 3 == 0
    for part, rows in (("first", raw.where(~late)), ("late", raw.where(late))):
        if not path_exists(spark, f"{root}/files-{part}/_SUCCESS"):
            write_fits_catalogs(rows, f"{root}/raw/{part}").write.mode("overwrite").parquet(f"{root}/files-{part}")
    return root


def ingest_fits(spark: SparkSession, sf_dir: str):
    """The whole of E1 on the FITS files; files that an earlier run has read are skipped."""
    from skycat.plans.ingest import ingest

    root = fits_root(spark, sf_dir)
    return ingest(spark, f"{root}/raw", f"{root}/processed")


@register(
    "fits_catalog",
    with_ctes("SELECT ra, dec, z, x, y, z_cart, weight, tracer, catalog FROM processed", PROCESSED_CTE),
)
def q_fits_catalog(spark, sf_dir):
    """E1 from FITS bytes: S1 -> S3 -> P1-P7 -> K1 -> S4."""
    from skycat.sources.catalog import read_catalog

    columns = ["ra", "dec", "z", "x", "y", "z_cart", "weight", "tracer", "catalog"]
    return read_catalog(spark, ingest_fits(spark, sf_dir).output, columns)


@register("fits_summary", SQL["catalog_summary"])
def q_fits_summary(spark, sf_dir):
    """A1 as E1 returns it, by catalogue name: the summary of the catalogue written from FITS files."""
    from skycat.plans.ingest import by_catalog

    return by_catalog(ingest_fits(spark, sf_dir).summary)


@register("incremental_catalog", SQL["fits_catalog"])
def q_incremental_catalog(spark, sf_dir):
    """S2 + K1: a part of the FITS files ingested first, then the folder with all of them; the second
    run reads the others only, and the catalogue is that of a single run."""
    import uuid

    from skycat.plans.ingest import ingest
    from skycat.sources.catalog import read_catalog

    root = fits_root(spark, sf_dir)
    out = scratch_path(spark, f"incremental-{uuid.uuid4().hex}")
    first = ingest(spark, f"{root}/raw/first", out)
    second = ingest(spark, f"{root}/raw", out)
    if set(first.read) & set(second.read):
        raise RuntimeError("a file was read again")
    return read_catalog(spark, out, ["ra", "dec", "z", "x", "y", "z_cart", "weight", "tracer", "catalog"])


@register("catalog_total", with_ctes("SELECT count(*) AS n_galaxies FROM processed", PROCESSED_CTE))
def q_catalog_total(spark, sf_dir):
    """A2: rows in the combined catalogue."""
    return summary.catalog_total(processed(spark, sf_dir))


# ---------------------------------------------------------------------------
# Sample, shuffle, export
# ---------------------------------------------------------------------------


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's sample at its full targets; a tracer with fewer rows gives all it has."""
    return sampling.weighted_stratified_sample(
        processed(spark, sf_dir), TARGET_PER_TRACER, id_cols="id", hash_method="md5", exhaust=True
    )


def _targets_sql(targets: dict[int, int] = TARGET_PER_TRACER) -> str:
    rows = ", ".join(f"({t}, {n})" for t, n in targets.items())
    return f"targets AS (SELECT * FROM (VALUES {rows}) v(tracer, target))"


def _wc_sql(weight: str = "CAST(weight AS DOUBLE)") -> str:
    return f"wc AS (SELECT *, CASE WHEN weight < 0 THEN CAST(0 AS DOUBLE) ELSE {weight} END AS wc FROM processed)"


STATS_CTE = """stats AS (SELECT tracer, count(*) AS available,
         sum(CASE WHEN isnan(wc) THEN 0 ELSE wc END) AS wsum,
         count_if(isnan(weight)) AS n_nan
       FROM wc GROUP BY tracer)"""

PLAN_CTE = """plan AS (SELECT tracer, least(target, available) AS n, (n_nan = 0 AND wsum > 0 AND target < available) AS weighted
       FROM stats JOIN targets USING (tracer) WHERE least(target, available) > 0)"""

KEYED_CTE = f"""keyed AS (SELECT wc.*, plan.n,
         CASE WHEN plan.weighted THEN -ln({uniform_sql(f'{SAMPLE_SEED}:key', 'id')}) / wc
              ELSE {uniform_sql(f'{SAMPLE_SEED}:key', 'id')} END AS _key
       FROM wc JOIN plan USING (tracer) WHERE NOT plan.weighted OR wc > 0)"""

SAMPLE_CTE = """sample AS (SELECT ra, dec, z, x, y, z_cart, weight, tracer, catalog, id FROM (
         SELECT *, row_number() OVER (PARTITION BY tracer ORDER BY _key, id) AS _rank FROM keyed)
       WHERE _rank <= n)"""

SAMPLE_CTES = (PROCESSED_CTE, _wc_sql(), STATS_CTE, _targets_sql(), PLAN_CTE, KEYED_CTE, SAMPLE_CTE)


@register("weighted_sample", with_ctes("SELECT * FROM sample", *SAMPLE_CTES))
def q_weighted_sample(spark, sf_dir):
    """Weighted stratified sample per tracer at the export's targets."""
    return sample(spark, sf_dir)


#: Targets below the rows of any tracer of the larger tables, so that rows are drawn at every scale.
DRAWN = {t: n // 100 for t, n in TARGET_PER_TRACER.items()}


@register("drawn_sample", with_ctes("SELECT * FROM sample", PROCESSED_CTE, _wc_sql(), STATS_CTE, _targets_sql(DRAWN), PLAN_CTE, KEYED_CTE, SAMPLE_CTE))
def q_drawn_sample(spark, sf_dir):
    """W1 where every tracer has more rows than its target."""
    return sampling.weighted_stratified_sample(processed(spark, sf_dir), DRAWN, id_cols="id", hash_method="md5", exhaust=True)


#: Factors of the weights by the whole degrees of ra, modulo 50: one row in fifty outweighs all others by far.
EXTREMES = ((1, 1e250), (10, 1e100), (30, 1.0), (50, 1e-250))


def _extreme_sql() -> str:
    cases = " ".join(f"WHEN CAST(floor(ra) AS INTEGER) % 50 < {m} THEN {dlit(f)}" for m, f in EXTREMES)
    return f"CAST(weight AS DOUBLE) * CASE {cases} END"


@register(
    "extreme_weight_sample",
    with_ctes("SELECT id, tracer, z FROM sample", PROCESSED_CTE, _wc_sql(_extreme_sql()), STATS_CTE, _targets_sql(DRAWN), PLAN_CTE, KEYED_CTE, SAMPLE_CTE),
)
def q_extreme_weight_sample(spark, sf_dir):
    """W1 with weights over 500 orders of magnitude: the cutoffs come from quantile sketches of the keys."""
    degrees = F.floor("ra").cast("int") % 50
    factor = None
    for m, f in EXTREMES:
        factor = F.when(degrees < m, F.lit(f)) if factor is None else factor.when(degrees < m, F.lit(f))
    rows = processed(spark, sf_dir).select("id", "tracer", "z", (F.col("weight").cast("double") * factor).alias("weight"))
    return sampling.weighted_stratified_sample(rows, DRAWN, id_cols="id", hash_method="md5", exhaust=True).drop("weight")


@register(
    "sample_summary",
    with_ctes(
        f"""SELECT s.tracer, {tracer_name_sql('s.tracer')} AS name, s.available, c.sampled
FROM stats s JOIN (SELECT tracer, count(*) AS sampled FROM sample GROUP BY tracer) c USING (tracer)""",
        *SAMPLE_CTES,
    ),
)
def q_sample_summary(spark, sf_dir):
    """A3: per tracer rows available and sampled."""
    return summary.sample_summary(processed(spark, sf_dir), sample(spark, sf_dir))


@register(
    "sample_bounds",
    with_ctes(
        """SELECT CAST(min(x) AS DOUBLE) AS x_min, CAST(max(x) AS DOUBLE) AS x_max,
       CAST(min(y) AS DOUBLE) AS y_min, CAST(max(y) AS DOUBLE) AS y_max,
       CAST(min(z_cart) AS DOUBLE) AS z_cart_min, CAST(max(z_cart) AS DOUBLE) AS z_cart_max FROM sample""",
        *SAMPLE_CTES,
    ),
)
def q_sample_bounds(spark, sf_dir):
    """A4: bounds of the exported sample."""
    return summary.bounds(sample(spark, sf_dir))


PERM_SQL = uniform_sql(f"{SAMPLE_SEED}:perm", "id")


@register(
    "shuffled_sample",
    with_ctes(
        f"SELECT *, row_number() OVER (ORDER BY {PERM_SQL}, id) - 1 AS position FROM sample",
        *SAMPLE_CTES,
    ),
)
def q_shuffled_sample(spark, sf_dir):
    """The sample in a reproducible random order, with its position."""
    return sampling.shuffle_with_position(sample(spark, sf_dir), id_cols="id", hash_method="md5")


@register(
    "capped_points",
    with_ctes(
        f"""SELECT x, y, z_cart, tracer, id FROM (
  SELECT *, row_number() OVER (ORDER BY {uniform_sql(f'{SAMPLE_SEED}:key', 'id')}, id) AS _rank,
         count(*) OVER () AS _n FROM processed)
WHERE _n <= {SCENE_MAX_POINTS} OR _rank <= {SCENE_MAX_POINTS}""",
        PROCESSED_CTE,
    ),
)
def q_capped_points(spark, sf_dir):
    """S5 + W2: projected scan, capped to the scene's point budget (a smaller catalogue passes whole)."""
    pts = processed(spark, sf_dir).select("x", "y", "z_cart", "tracer", "id")
    return sampling.cap_points(pts, SCENE_MAX_POINTS, id_cols="id", hash_method="md5")


@register(
    "random_points",
    with_ctes(
        "SELECT id, "
        + ", ".join(
            f"CAST(({uniform_sql(f'{SAMPLE_SEED}:{c}', 'id')} - 0.5) * {RANDOM_SPREAD!r} AS FLOAT) AS {c}"
            for c in ("x", "y", "z_cart")
        )
        + " FROM processed",
        PROCESSED_CTE,
    ),
)
def q_random_points(spark, sf_dir):
    """A uniform random comparison catalogue, one point per galaxy."""
    return sampling.random_points(processed(spark, sf_dir), id_cols="id", hash_method="md5")


@register(
    "generated_points",
    with_ctes(
        "SELECT id, "
        + ", ".join(
            f"CAST(({uniform_sql(f'{SAMPLE_SEED}:{c}', 'CAST(id AS VARCHAR)')} - 0.5) * {RANDOM_SPREAD!r} AS FLOAT) AS {c}" for c in ("x", "y", "z_cart")
        )
        + " FROM (SELECT unnest(range((SELECT count(*) FROM processed))) AS id) ids",
        PROCESSED_CTE,
    ),
)
def q_generated_points(spark, sf_dir):
    """W4 without an input: as many random points as the catalogue has galaxies."""
    n = processed(spark, sf_dir).count()
    return sampling.generated_points(spark, n, hash_method="md5")


#: What capped_points draws when the catalogue is larger than the cap at every scale.
CAP_PART = SCENE_MAX_POINTS // 400


@register(
    "drawn_points",
    with_ctes(
        f"""SELECT x, y, z_cart, tracer, id FROM (
  SELECT *, row_number() OVER (ORDER BY {uniform_sql(f'{SAMPLE_SEED}:key', 'id')}, id) AS _rank FROM processed)
WHERE _rank <= {CAP_PART}""",
        PROCESSED_CTE,
    ),
)
def q_drawn_points(spark, sf_dir):
    """W2 where the catalogue has more rows than the cap."""
    pts = processed(spark, sf_dir).select("x", "y", "z_cart", "tracer", "id")
    return sampling.cap_points(pts, CAP_PART, id_cols="id", hash_method="md5")


# ---------------------------------------------------------------------------
# Dimension lookups, distinct, validation
# ---------------------------------------------------------------------------


@register("present_tracers", with_ctes("SELECT DISTINCT tracer FROM processed", PROCESSED_CTE))
def q_present_tracers(spark, sf_dir):
    """A5: sorted distinct tracer ids."""
    return summary.present_tracers(processed(spark, sf_dir))


_RGB_SQL = "CASE tracer " + " ".join(
    f"WHEN {t} THEN [{', '.join(f'CAST({v!r} AS FLOAT)' for v in rgb)}]" for t, _n, _c, rgb, *_ in TRACERS
) + " ELSE [CAST(1.0 AS FLOAT), CAST(1.0 AS FLOAT), CAST(1.0 AS FLOAT)] END"


@register(
    "colored_points",
    with_ctes(
        f"""SELECT id, tracer, x, y, z_cart, {tracer_name_sql('tracer')} AS name,
       ({_RGB_SQL})[1] AS r, ({_RGB_SQL})[2] AS g, ({_RGB_SQL})[3] AS b,
       CAST({DEFAULT_POINT_SIZE} AS FLOAT) AS size, CAST({DEFAULT_OPACITY} AS FLOAT) AS alpha FROM processed""",
        PROCESSED_CTE,
    ),
)
def q_colored_points(spark, sf_dir):
    """J1 + P2 + P13: tracer name and colour by broadcast dimension lookup."""
    from skycat.operators.dims import color_points, tracer_dim, tracer_name

    pts = processed(spark, sf_dir).select("id", "tracer", "x", "y", "z_cart")
    # colour through the dimension table (J1's broadcast left join, 4 rows)
    out = color_points(pts, tracer_dim(spark)).withColumn("name", tracer_name("tracer"))
    return out.select(
        "id", "tracer", "x", "y", "z_cart", "name",
        F.col("rgb")[0].alias("r"), F.col("rgb")[1].alias("g"), F.col("rgb")[2].alias("b"),
        "size", "alpha",
    )


@register(
    "validate_catalog",
    with_ctes(
        f"""SELECT tracer, {tracer_name_sql('tracer')} AS name, count(*) AS n_rows,
       CAST(count_if(CAST(z AS DOUBLE) < z_min OR CAST(z AS DOUBLE) > z_max) AS BIGINT) AS n_outside_range,
       CAST(count_if(NOT (isfinite(ra) AND isfinite(dec) AND isfinite(z) AND isfinite(x) AND isfinite(y) AND isfinite(z_cart))) AS BIGINT) AS n_nonfinite,
       CAST(count_if(NOT (weight > 0) OR isnan(weight)) AS BIGINT) AS n_nonpositive_weight
FROM processed LEFT JOIN dim USING (tracer) GROUP BY tracer""",
        PROCESSED_CTE,
        "dim AS (SELECT * FROM (VALUES "
        + ", ".join(f"({t}, {dlit(zr[0])}, {dlit(zr[1])})" for t, _n, _c, _rgb, zr, _tg in TRACERS)
        + ") v(tracer, z_min, z_max))",
    ),
)
def q_validate_catalog(spark, sf_dir):
    """V1: per tracer rows, rows outside the nominal range, non-finite values, non-positive weights."""
    return summary.validate_catalog(processed(spark, sf_dir))


# ---------------------------------------------------------------------------
# Packed points, metadata, viewer work
# ---------------------------------------------------------------------------


VIEW_HIDDEN = frozenset({3})  # the QSO toggle switched off
VIEW_Z_CUTOFF = 1.2  # slider position


@register(
    "encoded_redshift",
    with_ctes(
        f"SELECT id, z, {encode_z_sql('z')} AS z_encoded, {decode_z_sql(encode_z_sql('z'))} AS z_decoded FROM processed",
        PROCESSED_CTE,
    ),
)
def q_encoded_redshift(spark, sf_dir):
    """P9 + P10: u16 quantisation of z and its decoding."""
    df = processed(spark, sf_dir)
    return df.select("id", "z", encode_z("z").alias("z_encoded"), decode_z(encode_z("z")).alias("z_decoded"))


def export_sample(spark: SparkSession, sf_dir: str) -> str:
    """E2 write side: shuffled sample -> one packed file + metadata, in the
    session's scratch folder.  Returns the folder."""
    out = scratch_path(spark, f"export-{_input(spark, sf_dir)}")
    if path_exists(spark, f"{out}/galaxies.bin") and path_exists(spark, f"{out}/metadata.json"):
        return out  # deterministic output already written for this input
    smp = sampling.shuffle_points(sample(spark, sf_dir), id_cols="id", hash_method="md5")
    packed.write_packed(smp, f"{out}/galaxies.bin", single_file=True)
    packed.write_metadata(packed.metadata_document(smp), f"{out}/metadata.json")
    return out


@register(
    "exported_points",
    with_ctes(
        f"SELECT x, y, z_cart, tracer, {decode_z_sql(encode_z_sql('z'))} AS z FROM sample",
        *SAMPLE_CTES,
    ),
)
def q_exported_points(spark, sf_dir):
    """K3 -> S6 (+P9, P10): the exported sample read back from the packed file."""
    return packed.read_packed(spark, f"{export_sample(spark, sf_dir)}/galaxies.bin")


@register("exported_parts", SQL["exported_points"])
def q_exported_parts(spark, sf_dir):
    """K3 -> S6 as a folder of parts: written, replaced as a whole, and read by its manifest."""
    folder = f"{scratch_path(spark, f'parts-{_input(spark, sf_dir)}')}/galaxies"
    points = sample(spark, sf_dir)
    packed.write_packed(points.where("tracer < 2"), folder, single_file=False)
    packed.write_packed(points.where("tracer >= 2"), folder, single_file=False, mode="append")
    return packed.read_packed(spark, folder)


@register(
    "export_metadata",
    with_ctes(
        """SELECT 1 AS version, count(*) AS n_points,
       CAST(min(x) AS DOUBLE) AS x_min, CAST(max(x) AS DOUBLE) AS x_max,
       CAST(min(y) AS DOUBLE) AS y_min, CAST(max(y) AS DOUBLE) AS y_max,
       CAST(min(z_cart) AS DOUBLE) AS z_min, CAST(max(z_cart) AS DOUBLE) AS z_max,
       CAST(@H0 AS DOUBLE) AS H0, CAST(@OM0 AS DOUBLE) AS Om0, @MODEL AS model, 4 AS n_tracers FROM sample""".replace("@H0", repr(H0)).replace("@OM0", repr(OM0)).replace("@MODEL", slit(COSMOLOGY_MODEL)),
        *SAMPLE_CTES,
    ),
)
def q_export_metadata(spark, sf_dir):
    """K4 -> S7: the metadata document written with the export, read back."""
    meta = packed.read_metadata(spark, f"{export_sample(spark, sf_dir)}/metadata.json")
    b = F.col("bounds")
    return meta.select(
        "version",
        "n_points",
        b.x[0].alias("x_min"), b.x[1].alias("x_max"),
        b.y[0].alias("y_min"), b.y[1].alias("y_max"),
        b.z[0].alias("z_min"), b.z[1].alias("z_max"),
        F.col("cosmology.H0").alias("H0"), F.col("cosmology.Om0").alias("Om0"), F.col("cosmology.model").alias("model"),
        F.size("tracers").alias("n_tracers"),
    )


def _hidden_sql(tracer: str, z: str) -> str:
    hid = ", ".join(str(t) for t in sorted(VIEW_HIDDEN))
    return f"({tracer} IN ({hid}) OR {z} > {dlit(VIEW_Z_CUTOFF)})"


@register(
    "styled_points",
    with_ctes(
        f"""SELECT id, tracer, z,
       CAST(CASE WHEN {_hidden_sql('tracer', 'z')} THEN 0.0 ELSE {DEFAULT_POINT_SIZE} END AS FLOAT) AS size,
       CAST(CASE WHEN {_hidden_sql('tracer', 'z')} THEN 0.0 ELSE {DEFAULT_OPACITY} END AS FLOAT) AS alpha FROM processed""",
        PROCESSED_CTE,
    ),
)
def q_styled_points(spark, sf_dir):
    """Per-point size and alpha under the viewer's filters (rows kept)."""
    pts = processed(spark, sf_dir).select("id", "tracer", "z")
    return view.style_points(pts, z_cutoff=VIEW_Z_CUTOFF, hidden=VIEW_HIDDEN)


@register(
    "visible_points",
    with_ctes(f"SELECT id, tracer, z FROM processed WHERE NOT {_hidden_sql('tracer', 'z')}", PROCESSED_CTE),
)
def q_visible_points(spark, sf_dir):
    """The visible points as a filter."""
    pts = processed(spark, sf_dir).select("id", "tracer", "z")
    return view.visible_points(pts, z_cutoff=VIEW_Z_CUTOFF, hidden=VIEW_HIDDEN)


@register(
    "scene_points",
    with_ctes(
        f"""SELECT id, tracer, CAST(x * {dlit(0.001)} AS FLOAT) AS x, CAST(y * {dlit(0.001)} AS FLOAT) AS y,
       CAST(z_cart * {dlit(0.001)} AS FLOAT) AS z_cart FROM (
  SELECT *, row_number() OVER (ORDER BY {uniform_sql(f'{SAMPLE_SEED}:key', 'id')}, id) AS _rank,
         count(*) OVER () AS _n FROM processed)
WHERE tracer IN (SELECT DISTINCT tracer FROM processed) AND (_n <= {SCENE_MAX_POINTS} OR _rank <= {SCENE_MAX_POINTS})""",
        PROCESSED_CTE,
    ),
)
def q_scene_points(spark, sf_dir):
    """Projected scan (S5) -> cap (W2) -> scale (P8), in one pass; W5's sink splits by directory."""
    from skycat.functions.coords import scale_coords

    pts = processed(spark, sf_dir).select("id", "tracer", "x", "y", "z_cart")
    return scale_coords(sampling.cap_points(pts, SCENE_MAX_POINTS, id_cols="id", hash_method="md5"), 0.001)


def _projected_sql() -> str:
    return f"projected AS ({view.project_points_sql('processed')})"


@register(
    "projected_points",
    with_ctes("SELECT id, px, py, depth, size_px FROM projected", PROCESSED_CTE, _projected_sql()),
)
def q_projected_points(spark, sf_dir):
    """G1 + G2: default orbit camera, 1920x1080, every point in view."""
    pts = processed(spark, sf_dir).select("id", "x", "y", "z_cart")
    return view.project_points(pts).select("id", "px", "py", "depth", "size_px")


#: A camera inside the catalogue that sees a part of it.
NEAR_CAMERA = view.orbit_camera(radius=500.0, target=(1500.0, 700.0, -900.0))
NEAR_VIEWPORT = view.Viewport(960, 540, far=800.0)


@register(
    "near_view_points",
    with_ctes("SELECT id, px, py, depth, size_px FROM projected", PROCESSED_CTE, f"projected AS ({view.project_points_sql('processed', NEAR_CAMERA, NEAR_VIEWPORT)})"),
)
def q_near_view_points(spark, sf_dir):
    """G2 + S5: a near camera; the box around its frustum reaches the scan of the ordered catalogue."""
    pts = processed(spark, sf_dir).select("id", "x", "y", "z_cart")
    return view.project_points(pts, NEAR_CAMERA, NEAR_VIEWPORT).select("id", "px", "py", "depth", "size_px")


@register(
    "density_image",
    with_ctes(
        view.density_image_sql("splatted"),
        PROCESSED_CTE,
        f"""colored AS (SELECT x, y, z_cart, tracer, z, ({_RGB_SQL})[1] AS r, ({_RGB_SQL})[2] AS g,
       ({_RGB_SQL})[3] AS b, CAST({dlit(DEFAULT_OPACITY)} AS DOUBLE) AS alpha FROM processed WHERE NOT {_hidden_sql('tracer', 'z')})""",
        f"proj AS ({view.project_points_sql('colored')})",
        f"splatted AS ({view.splat_sql('proj')})",
    ),
)
def q_density_image(spark, sf_dir):
    """E3 whole: visible -> colour -> project -> splat -> additive image."""
    return view.render(processed(spark, sf_dir), z_cutoff=VIEW_Z_CUTOFF, hidden=VIEW_HIDDEN)


@register(
    "rendered_export",
    with_ctes(
        view.density_image_sql("splatted"),
        *SAMPLE_CTES,
        f"exported AS (SELECT x, y, z_cart, tracer, {decode_z_sql(encode_z_sql('z'))} AS z FROM sample)",
        f"""colored AS (SELECT x, y, z_cart, tracer, z, ({_RGB_SQL})[1] AS r, ({_RGB_SQL})[2] AS g,
       ({_RGB_SQL})[3] AS b, CAST({dlit(DEFAULT_OPACITY)} AS DOUBLE) AS alpha FROM exported WHERE NOT {_hidden_sql('tracer', 'z')})""",
        f"proj AS ({view.project_points_sql('colored')})",
        f"splatted AS ({view.splat_sql('proj')})",
    ),
)
def q_rendered_export(spark, sf_dir):
    """E3 from an export, as the viewer starts: S6 + S7 -> P13 -> P12 -> G1-G4."""
    from skycat.plans.export import read_export

    points, _ = read_export(spark, export_sample(spark, sf_dir))
    return view.render(points, z_cutoff=VIEW_Z_CUTOFF, hidden=VIEW_HIDDEN)


# ---------------------------------------------------------------------------
# Manifest, union, split, counts
# ---------------------------------------------------------------------------


_MANIFEST_SQL = "manifest AS (SELECT * FROM (VALUES " + ", ".join(f"({slit(m)})" for m in MANIFEST) + ") v(file_name))"


@register(
    "manifest_status",
    with_ctes(
        "SELECT file_name, file_name IN (SELECT DISTINCT file_name FROM raw) AS present FROM manifest",
        RAW_CTE,
        _MANIFEST_SQL,
    ),
)
def q_manifest_status(spark, sf_dir):
    """Each manifest entry, present or missing among the catalogue's files."""
    from skycat.operators.dims import manifest_df
    from skycat.sources.catalog import manifest_status

    return manifest_status(manifest_df(spark), raw_catalog(spark, sf_dir).select("file_name"))


@register("combined_catalogs", with_ctes("SELECT * FROM processed", PROCESSED_CTE))
def q_combined_catalogs(spark, sf_dir):
    """K1 -> U1: every per-catalogue table of the tree, whatever its name, as one scan; no dedup."""
    from skycat.sources.tables import materialized

    rows = processed(spark, sf_dir)
    per_catalog = materialized(spark, f"per-catalog-{_input(spark, sf_dir)}", lambda: rows, ("catalog",))
    return per_catalog.select(*rows.columns)


@register("combined_table", SQL["fits_catalog"])
def q_combined_table(spark, sf_dir):
    """K1 -> K2 -> S4: the per-catalogue tables of an ingest written as one table and read back."""
    import uuid

    from skycat.sources.catalog import read_catalog, write_combined

    out = scratch_path(spark, f"combined-{uuid.uuid4().hex}")
    write_combined(read_catalog(spark, ingest_fits(spark, sf_dir).output), out)
    return read_catalog(spark, out, ["ra", "dec", "z", "x", "y", "z_cart", "weight", "tracer", "catalog"])


@register(
    "tracer_subsets",
    with_ctes(
        "SELECT tracer, count(*) AS n_points, CAST(min(z) AS DOUBLE) AS z_min, CAST(max(z) AS DOUBLE) AS z_max "
        "FROM processed GROUP BY tracer",
        PROCESSED_CTE,
    ),
)
def q_tracer_subsets(spark, sf_dir):
    """One subset per present tracer (A5), each summarised.

    Reads W5's sink layout (one directory per tracer), so every subset scan
    prunes to its own directory instead of rescanning the catalogue.
    """
    from functools import reduce

    from skycat.sources.tables import materialized

    by_tracer = materialized(
        spark, f"per-tracer-{_input(spark, sf_dir)}", lambda: processed(spark, sf_dir).select("tracer", "z"), ("tracer",)
    )
    parts = sampling.split_by_tracer(by_tracer)
    rows = [
        sub.agg(
            F.lit(t).cast("short").alias("tracer"),
            F.count(F.lit(1)).alias("n_points"),
            F.min("z").cast("double").alias("z_min"),
            F.max("z").cast("double").alias("z_max"),
        )
        for t, sub in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@register("exported_point_count", with_ctes("SELECT count(*) AS n_galaxies FROM sample", *SAMPLE_CTES))
def q_exported_point_count(spark, sf_dir):
    """Points loaded from the packed file (equals the metadata's n_points)."""
    return summary.catalog_total(packed.read_packed(spark, f"{export_sample(spark, sf_dir)}/galaxies.bin"))


@register(
    "processed_summary",
    with_ctes(
        f"""SELECT catalog, {tracer_name_sql('tracer')} AS tracer, count(*) AS n_galaxies,
       {format_count_sql('count(*)')} AS galaxies, min(z) AS z_min, max(z) AS z_max,
       {format_z_range_sql('min(z)', 'max(z)')} AS z_range
FROM processed GROUP BY catalog, tracer""",
        PROCESSED_CTE,
    ),
)
def q_processed_summary(spark, sf_dir):
    """A1 over the processed catalogue (as read back after E1's write)."""
    return summary.catalog_summary_processed(processed(spark, sf_dir))
