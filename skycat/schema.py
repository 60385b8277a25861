"""Schemas and fixed values of the catalogue data model.

Everything in the block marked FIXED VALUES must stay equal to the values the
original pipeline uses, otherwise outputs (tracer ids, colours, packed files,
metadata documents) stop matching.  Everything else here is our own.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original pipeline's; do not edit)
# ---------------------------------------------------------------------------

# Cosmology: flat Lambda-CDM, no radiation term; speed of light in km/s.
H0 = 67.4
OM0 = 0.315
C_KM_S = 299792.458
COSMOLOGY_MODEL = "FlatLambdaCDM"

# Quality cut: keep LO_Z < z < HI_Z (strict) and finite ra, dec.
QUALITY_Z_MIN = 0.001
QUALITY_Z_MAX = 5.0

# Catalogue manifest, in download order.
MANIFEST = [
    "BGS_BRIGHT_N_clustering.dat.fits",
    "BGS_BRIGHT_S_clustering.dat.fits",
    "BGS_BRIGHT-21.5_N_clustering.dat.fits",
    "BGS_BRIGHT-21.5_S_clustering.dat.fits",
    "LRG_N_clustering.dat.fits",
    "LRG_S_clustering.dat.fits",
    "ELG_LOPnotqso_N_clustering.dat.fits",
    "ELG_LOPnotqso_S_clustering.dat.fits",
    "QSO_N_clustering.dat.fits",
    "QSO_S_clustering.dat.fits",
]
CATALOG_SUFFIX = "_clustering.dat.fits"
CATALOG_GLOB = "*_clustering.dat.fits"
FITS_EXTENSION = "LSS"

# File-name prefix -> tracer id, tested in this order; no match -> 0.
TRACER_PREFIXES = [
    ("BGS_BRIGHT-21.5", 0),
    ("BGS_BRIGHT", 0),
    ("LRG", 1),
    ("ELG_LOPnotqso", 2),
    ("QSO", 3),
]
DEFAULT_TRACER = 0

# Tracer dimension: id, name, colour, RGB used by the viewer, redshift range
# shown in the metadata document, sampling target for the web export.
TRACERS = [
    (0, "BGS", "#FF8C00", (1.0, 0.549, 0.0), (0.01, 0.6), 100_000),
    (1, "LRG", "#CC2200", (0.8, 0.133, 0.0), (0.4, 1.1), 150_000),
    (2, "ELG", "#00CED1", (0.0, 0.808, 0.820), (0.8, 1.6), 150_000),
    (3, "QSO", "#8888FF", (0.533, 0.533, 1.0), (0.8, 2.1), 100_000),
]
UNKNOWN_RGB = (1.0, 1.0, 1.0)

# Packed point file: little-endian header <IIII (magic, version, n, flags),
# then n records <fffBBH (x, y, z_cart, tracer, reserved, z * 10000).
PACKED_MAGIC = 0x44455349
PACKED_VERSION = 1
PACKED_HEADER_BYTES = 16
PACKED_RECORD_BYTES = 16
Z_ENCODE_SCALE = 10000
Z_ENCODE_MAX = 65535

# Metadata document.
METADATA_VERSION = 1
DATA_RELEASE = "DESI DR1 guadalupe/v1.0"

# Random seed of the sampling steps; cap of the scene loader (function
# default and command-line default); Mpc -> scene units.
SAMPLE_SEED = 42
SCENE_MAX_POINTS = 1_400_000
SCENE_MAX_POINTS_CLI = 2_000_000
SCENE_SCALE = 0.001

# Side of the cube of random points (Mpc).
RANDOM_SPREAD = 40_000.0

# Viewer: render option defaults, camera defaults and limits, projection.
DEFAULT_POINT_SIZE = 1.5
DEFAULT_OPACITY = 0.7
DEFAULT_Z_CUTOFF = 2.1
CAMERA_THETA = 0.3  # times pi
CAMERA_PHI = 0.35  # times pi
CAMERA_RADIUS = 4000.0
CAMERA_MIN_RADIUS = 50.0
CAMERA_MAX_RADIUS = 20_000.0
CAMERA_PHI_MARGIN = 0.001
CAMERA_FOV_DEG = 60.0
CAMERA_NEAR = 1.0
CAMERA_FAR = 50_000.0
POINT_SIZE_SCALE = 400.0
SPLAT_EDGE_LO = 0.3
SPLAT_EDGE_HI = 0.5

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

TRACER_NAMES = {t[0]: t[1] for t in TRACERS}
TARGET_PER_TRACER = {t[0]: t[5] for t in TRACERS}

# Raw catalogue rows as read from a FITS extension (plus provenance).
RAW_SCHEMA = T.StructType(
    [
        T.StructField("RA", T.DoubleType()),
        T.StructField("DEC", T.DoubleType()),
        T.StructField("Z", T.DoubleType()),
        T.StructField("WEIGHT", T.FloatType()),
    ]
)

# D2 (+ provenance columns): the processed catalogue.  Spark has no unsigned
# types, so the uint8 tracer is a short.
CATALOG_COLUMNS = ["ra", "dec", "z", "x", "y", "z_cart", "weight", "tracer"]
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("ra", T.FloatType()),
        T.StructField("dec", T.FloatType()),
        T.StructField("z", T.FloatType()),
        T.StructField("x", T.FloatType()),
        T.StructField("y", T.FloatType()),
        T.StructField("z_cart", T.FloatType()),
        T.StructField("weight", T.FloatType()),
        T.StructField("tracer", T.ShortType()),
    ]
)
PROVENANCE_FIELDS = [
    T.StructField("catalog", T.StringType()),
    T.StructField("row_index", T.LongType()),
]

# Decoded packed points.
POINTS_SCHEMA = T.StructType(
    [
        T.StructField("x", T.FloatType()),
        T.StructField("y", T.FloatType()),
        T.StructField("z_cart", T.FloatType()),
        T.StructField("tracer", T.ShortType()),
        T.StructField("z", T.FloatType()),
    ]
)

# Metadata document.
RANGE = T.ArrayType(T.DoubleType())
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("n_points", T.LongType()),
        T.StructField(
            "tracers",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("color", T.StringType()),
                        T.StructField("z_range", RANGE),
                    ]
                ),
            ),
        ),
        T.StructField(
            "bounds",
            T.StructType(
                [
                    T.StructField("x", RANGE),
                    T.StructField("y", RANGE),
                    T.StructField("z", RANGE),
                ]
            ),
        ),
        T.StructField(
            "cosmology",
            T.StructType(
                [
                    T.StructField("H0", T.DoubleType()),
                    T.StructField("Om0", T.DoubleType()),
                    T.StructField("model", T.StringType()),
                ]
            ),
        ),
        T.StructField("data_release", T.StringType()),
    ]
)

TRACER_DIM_SCHEMA = T.StructType(
    [
        T.StructField("tracer", T.ShortType()),
        T.StructField("name", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("rgb", T.ArrayType(T.FloatType())),
        T.StructField("z_min", T.DoubleType()),
        T.StructField("z_max", T.DoubleType()),
        T.StructField("target", T.LongType()),
    ]
)
