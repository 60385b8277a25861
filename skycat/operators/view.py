"""The viewer's per-point work as DataFrame operations.

The original shades one point per GPU lane and blends into a framebuffer.
Here the same maths runs over every row of a catalogue: a camera (G1, a few
driver-side numbers that enter the plan as literals), a perspective
projection per point (G2, Column arithmetic), a round soft-edged footprint
(G3, ``explode`` over the few pixels a near point covers) and additive
blending (G4, a per-pixel sum).  Additive blending is order-free, so the image
is a plain hash aggregation with partial sums in every task: a pixel that
receives a third of all points costs one partial row per task.

Each Spark expression has a SQL twin with the same operations in the same
order (``*_sql``), used by the DuckDB oracle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycat.functions.sqltext import dlit
from skycat.schema import (
    CAMERA_FAR,
    CAMERA_FOV_DEG,
    CAMERA_MAX_RADIUS,
    CAMERA_MIN_RADIUS,
    CAMERA_NEAR,
    CAMERA_PHI,
    CAMERA_PHI_MARGIN,
    CAMERA_RADIUS,
    CAMERA_THETA,
    DEFAULT_OPACITY,
    DEFAULT_POINT_SIZE,
    DEFAULT_Z_CUTOFF,
    POINT_SIZE_SCALE,
    SPLAT_EDGE_HI,
    SPLAT_EDGE_LO,
)

# ---------------------------------------------------------------------------
# P11 / P12
# ---------------------------------------------------------------------------


def _hidden(tracer: Column, z: Column, z_cutoff: float, hidden: set[int] | frozenset[int]) -> Column:
    cond = z > F.lit(float(z_cutoff))
    if hidden:
        cond = tracer.isin(sorted(hidden)) | cond
    return cond


def style_points(
    df: DataFrame,
    *,
    point_size: float = DEFAULT_POINT_SIZE,
    opacity: float = DEFAULT_OPACITY,
    z_cutoff: float = DEFAULT_Z_CUTOFF,
    hidden: set[int] | frozenset[int] = frozenset(),
) -> DataFrame:
    """Size and alpha per point; 0 when hidden (tracer hidden or z > cutoff)."""
    h = _hidden(F.col("tracer"), F.col("z"), z_cutoff, hidden)
    return df.withColumns(
        {
            "size": F.when(h, F.lit(0.0)).otherwise(F.lit(float(point_size))).cast("float"),
            "alpha": F.when(h, F.lit(0.0)).otherwise(F.lit(float(opacity))).cast("float"),
        }
    )


def visible_points(
    df: DataFrame, *, z_cutoff: float = DEFAULT_Z_CUTOFF, hidden: set[int] | frozenset[int] = frozenset()
) -> DataFrame:
    """The visible points as a filter (z equal to the cutoff stays visible;
    unknown tracers are visible unless listed).  Both predicates reach the
    Parquet scan as pushed filters."""
    cond = F.col("z") <= F.lit(float(z_cutoff))
    if hidden:
        cond = cond & ~F.col("tracer").isin(sorted(hidden))
    return df.where(cond)


# ---------------------------------------------------------------------------
# G1 camera
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Camera:
    eye: tuple[float, float, float]
    # rows of the view rotation (camera x, y, z axes in world coordinates)
    right: tuple[float, float, float]
    up: tuple[float, float, float]
    back: tuple[float, float, float]

    def view_terms(self):
        """(row, offset) per view axis: v = row . p + offset, offset = -row . eye."""
        out = []
        for row in (self.right, self.up, self.back):
            out.append((row, -(row[0] * self.eye[0] + row[1] * self.eye[1] + row[2] * self.eye[2])))
        return out


def _norm(v):
    n = math.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return (v[0] / n, v[1] / n, v[2] / n)


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def orbit_camera(
    theta: float = CAMERA_THETA * math.pi,
    phi: float = CAMERA_PHI * math.pi,
    radius: float = CAMERA_RADIUS,
    target: tuple[float, float, float] = (0.0, 0.0, 0.0),
) -> Camera:
    """G1: orbit position around ``target`` (y up), looking at it.

    x = r cos(phi) sin(theta), y = r sin(phi), z = r cos(phi) cos(theta);
    phi limited to +-(pi/2 - 0.001), r to [50, 20000].
    """
    lim = math.pi / 2 - CAMERA_PHI_MARGIN
    phi = max(-lim, min(lim, phi))
    radius = max(CAMERA_MIN_RADIUS, min(CAMERA_MAX_RADIUS, radius))
    off = (radius * math.cos(phi) * math.sin(theta), radius * math.sin(phi), radius * math.cos(phi) * math.cos(theta))
    eye = (target[0] + off[0], target[1] + off[1], target[2] + off[2])
    back = _norm((eye[0] - target[0], eye[1] - target[1], eye[2] - target[2]))
    right = _norm(_cross((0.0, 1.0, 0.0), back))
    up = _cross(back, right)
    return Camera(eye, right, up, back)


# ---------------------------------------------------------------------------
# G2 projection
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Viewport:
    width: int = 1920
    height: int = 1080
    fov_deg: float = CAMERA_FOV_DEG
    near: float = CAMERA_NEAR
    far: float = CAMERA_FAR

    @property
    def f(self) -> float:
        return 1.0 / math.tan(math.radians(self.fov_deg) / 2.0)

    @property
    def fx(self) -> float:
        return self.f / (self.width / self.height)


def frustum_bounds(camera: Camera, viewport: Viewport, point_size: float = DEFAULT_POINT_SIZE) -> list[tuple[float, float]]:
    """(low, high) of x, y and z_cart of all points that ``project_points`` can keep, as float32 values.

    A point at depth d whose footprint (size * 400 / d pixels) touches the image has
    |v_x| <= (d + size * 400 / width) / fx, and |v_y| likewise, so between near and far the
    points fill a convex body whose eight corners bound it.
    """
    reach = float(point_size) * POINT_SIZE_SCALE
    corners = []
    for d in (viewport.near, viewport.far):
        vx, vy = (d + reach / viewport.width) / viewport.fx, (d + reach / viewport.height) / viewport.f
        corners += [
            [e + r * sx * vx + u * sy * vy - b * d for e, r, u, b in zip(camera.eye, camera.right, camera.up, camera.back)]
            for sx in (-1, 1)
            for sy in (-1, 1)
        ]
    out = []
    for axis in zip(*corners):
        slack = 1e-6 * (max(map(abs, axis)) + 1.0)  # above the rounding of the projection
        low, high = np.float32(min(axis) - slack), np.float32(max(axis) + slack)
        out.append((float(np.nextafter(low, np.float32(-np.inf))), float(np.nextafter(high, np.float32(np.inf)))))
    return out


def project_points(
    df: DataFrame,
    camera: Camera | None = None,
    viewport: Viewport = Viewport(),
    *,
    point_size: float = DEFAULT_POINT_SIZE,
) -> DataFrame:
    """Screen position and point size of every point in front of the camera.

    Adds ``sx, sy`` (continuous pixel coordinates), ``px, py`` (pixel), ``depth``
    and ``size_px`` = size * 400 / depth.  Points behind the camera, nearer than
    ``near``, farther than ``far`` or outside the image are dropped.

    The box around what the camera sees is a filter on x, y and z_cart alone, which
    reaches the scan: of a catalogue in curve order (``layout``) only the row groups
    in view are read.
    """
    camera = camera or orbit_camera()
    for c, (low, high) in zip(("x", "y", "z_cart"), frustum_bounds(camera, viewport, point_size)):
        df = df.where(F.col(c).between(F.lit(low).cast("float"), F.lit(high).cast("float")))
    p = [F.col(c).cast("double") for c in ("x", "y", "z_cart")]
    (r0, o0), (r1, o1), (r2, o2) = camera.view_terms()

    def dot(row, off):
        return p[0] * F.lit(row[0]) + p[1] * F.lit(row[1]) + p[2] * F.lit(row[2]) + F.lit(off)

    vp = viewport
    out = df.withColumns({"_vx": dot(r0, o0), "_vy": dot(r1, o1), "depth": -dot(r2, o2)})
    out = out.where((F.col("depth") >= F.lit(vp.near)) & (F.col("depth") <= F.lit(vp.far)))
    out = out.withColumns(
        {
            "sx": (F.lit(vp.fx) * F.col("_vx") / F.col("depth") + F.lit(1.0)) * F.lit(vp.width / 2.0),
            "sy": (F.lit(1.0) - F.lit(vp.f) * F.col("_vy") / F.col("depth")) * F.lit(vp.height / 2.0),
            "size_px": F.lit(float(point_size) * POINT_SIZE_SCALE) / F.col("depth"),
        }
    )
    # the footprint may still reach into the image from outside; keep a point if
    # any of it can.  Filtering first bounds sx, sy before the integer casts.
    reach = F.col("size_px") / F.lit(2.0)
    out = out.where(
        (F.col("sx") + reach >= F.lit(0.0))
        & (F.col("sx") - reach < F.lit(float(vp.width)))
        & (F.col("sy") + reach >= F.lit(0.0))
        & (F.col("sy") - reach < F.lit(float(vp.height)))
    )
    return out.withColumns({"px": F.floor("sx").cast("int"), "py": F.floor("sy").cast("int")}).drop("_vx", "_vy")


def project_points_sql(src: str, camera: Camera | None = None, viewport: Viewport = Viewport(), point_size: float = DEFAULT_POINT_SIZE) -> str:
    camera = camera or orbit_camera()
    (r0, o0), (r1, o1), (r2, o2) = camera.view_terms()
    vp = viewport

    def dot(row, off):
        return (
            f"(CAST(x AS DOUBLE) * {dlit(row[0])} + CAST(y AS DOUBLE) * {dlit(row[1])} + "
            f"CAST(z_cart AS DOUBLE) * {dlit(row[2])} + {dlit(off)})"
        )

    return f"""
SELECT *, CAST(floor(sx) AS INTEGER) AS px, CAST(floor(sy) AS INTEGER) AS py FROM (
  SELECT *, ({dlit(vp.fx)} * _vx / depth + {dlit(1.0)}) * {dlit(vp.width / 2.0)} AS sx,
            ({dlit(1.0)} - {dlit(vp.f)} * _vy / depth) * {dlit(vp.height / 2.0)} AS sy,
            {dlit(float(point_size) * POINT_SIZE_SCALE)} / depth AS size_px
  FROM (SELECT *, {dot(r0, o0)} AS _vx, {dot(r1, o1)} AS _vy, -{dot(r2, o2)} AS depth FROM {src})
  WHERE depth >= {dlit(vp.near)} AND depth <= {dlit(vp.far)}
) WHERE sx + size_px / 2.0 >= 0 AND sx - size_px / 2.0 < {dlit(float(vp.width))}
    AND sy + size_px / 2.0 >= 0 AND sy - size_px / 2.0 < {dlit(float(vp.height))}
"""


# ---------------------------------------------------------------------------
# G3 footprint and G4 image
# ---------------------------------------------------------------------------


def _smoothstep(e0: float, e1: float, x: Column) -> Column:
    t = F.least(F.greatest((x - F.lit(e0)) / F.lit(e1 - e0), F.lit(0.0)), F.lit(1.0))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def splat(df: DataFrame, viewport: Viewport = Viewport()) -> DataFrame:
    """The pixels a projected point covers, with its soft-edge coverage.

    A point of size s <= 1 px lights its own pixel at full coverage.  A larger
    point lights the pixels whose centres lie within its s x s square, at
    1 - smoothstep(0.3, 0.5, r), r the distance from the centre in units of s;
    pixels with r > 0.5 are discarded.  Footprints are clipped to the image,
    so no point produces more rows than the image has pixels.

    Small points, nearly all of a catalogue, go on as they are: only a large
    one gets its lists of pixel columns and rows (the clipped footprint, empty
    when nothing is inside the image) and is exploded.
    """
    vp = viewport
    big = F.col("size_px") > F.lit(1.0)
    inside = F.col("px").between(0, vp.width - 1) & F.col("py").between(0, vp.height - 1)
    small = df.where(~big & inside).withColumn("coverage", F.lit(1.0))
    half = F.col("size_px") / F.lit(2.0)
    lo_x = F.greatest(F.ceil(F.col("sx") - half - F.lit(0.5)), F.lit(0)).cast("int")
    hi_x = F.least(F.floor(F.col("sx") + half - F.lit(0.5)), F.lit(vp.width - 1)).cast("int")
    lo_y = F.greatest(F.ceil(F.col("sy") - half - F.lit(0.5)), F.lit(0)).cast("int")
    hi_y = F.least(F.floor(F.col("sy") + half - F.lit(0.5)), F.lit(vp.height - 1)).cast("int")
    out = (
        df.where(big)
        .withColumns({"_lpx": lo_x, "_hpx": hi_x, "_lpy": lo_y, "_hpy": hi_y})
        .where((F.col("_lpx") <= F.col("_hpx")) & (F.col("_lpy") <= F.col("_hpy")))
        .withColumn("px", F.explode(F.sequence("_lpx", "_hpx")))
        .withColumn("py", F.explode(F.sequence("_lpy", "_hpy")))
        .drop("_lpx", "_hpx", "_lpy", "_hpy")
    )
    dx = (F.col("px").cast("double") + F.lit(0.5) - F.col("sx")) / F.col("size_px")
    dy = (F.col("py").cast("double") + F.lit(0.5) - F.col("sy")) / F.col("size_px")
    out = out.withColumn("_r", F.sqrt(dx * dx + dy * dy)).where(F.col("_r") <= F.lit(0.5))
    large = out.withColumn("coverage", F.lit(1.0) - _smoothstep(SPLAT_EDGE_LO, SPLAT_EDGE_HI, F.col("_r"))).drop("_r")
    return small.unionByName(large)


def splat_sql(src: str, viewport: Viewport = Viewport()) -> str:
    """SQL twin of ``splat`` over a relation with px, py, sx, sy, size_px."""
    w, h = viewport.width, viewport.height
    e0, e1 = dlit(SPLAT_EDGE_LO), dlit(SPLAT_EDGE_HI)
    t = f"least(greatest((_r - {e0}) / {dlit(SPLAT_EDGE_HI - SPLAT_EDGE_LO)}, {dlit(0.0)}), {dlit(1.0)})"
    return f"""
SELECT * EXCLUDE (_r), {dlit(1.0)} - ({t}) * ({t}) * ({dlit(3.0)} - {dlit(2.0)} * ({t})) AS coverage FROM (
  SELECT * EXCLUDE (px, py, _lx, _hx, _ly, _hy), CAST(gx.px AS INTEGER) AS px, CAST(gy.py AS INTEGER) AS py,
         sqrt(((CAST(gx.px AS DOUBLE) + {dlit(0.5)} - sx) / size_px) * ((CAST(gx.px AS DOUBLE) + {dlit(0.5)} - sx) / size_px)
            + ((CAST(gy.py AS DOUBLE) + {dlit(0.5)} - sy) / size_px) * ((CAST(gy.py AS DOUBLE) + {dlit(0.5)} - sy) / size_px)) AS _r
  FROM (SELECT *,
          CAST(greatest(ceil(sx - size_px / {dlit(2.0)} - {dlit(0.5)}), 0) AS INTEGER) AS _lx,
          CAST(least(floor(sx + size_px / {dlit(2.0)} - {dlit(0.5)}), {w - 1}) AS INTEGER) AS _hx,
          CAST(greatest(ceil(sy - size_px / {dlit(2.0)} - {dlit(0.5)}), 0) AS INTEGER) AS _ly,
          CAST(least(floor(sy + size_px / {dlit(2.0)} - {dlit(0.5)}), {h - 1}) AS INTEGER) AS _hy
        FROM {src} WHERE size_px > {dlit(1.0)}) big,
       generate_series(big._lx, big._hx) gx(px), generate_series(big._ly, big._hy) gy(py)
  WHERE big._lx <= big._hx AND big._ly <= big._hy
) WHERE _r <= {e1}
UNION ALL BY NAME
SELECT *, {dlit(1.0)} AS coverage FROM {src}
WHERE size_px <= {dlit(1.0)} AND px >= 0 AND px < {w} AND py >= 0 AND py < {h}
"""


#: Parts of a unit in which a point's light is counted: whole numbers add up to the same sum in any order.
LIGHT_UNITS = float(1 << 32)


def density_image_sql(src: str) -> str:
    """SQL twin of ``density_image`` over a relation with px, py, coverage, r, g, b, alpha."""
    a = "(CAST(alpha AS DOUBLE) * coverage)"
    unit = dlit(LIGHT_UNITS)
    sums = ", ".join(f"least({dlit(1.0)}, CAST(sum(CAST(floor(CAST({c} AS DOUBLE) * {a} * {unit} + {dlit(0.5)}) AS BIGINT)) AS DOUBLE) / {unit}) AS {c}" for c in "rgb")
    return f"SELECT px, py, {sums}, count(*) AS n_points FROM {src} GROUP BY px, py"


def density_image(points: DataFrame, viewport: Viewport = Viewport()) -> DataFrame:
    """Additive blend per pixel: sum of rgb * alpha * coverage, clamped to 1.

    ``points`` carries ``px, py, coverage`` (from ``splat``), ``rgb`` and
    ``alpha``.  Output: px, py, r, g, b, n_points.  Each point adds a whole
    number of units of 2^-32, so a pixel is the same to the last bit on any
    partitioning.  A sum beyond 64 bits stands for more than 2^31 times full
    light and is clamped as any above 1.
    """
    a = F.col("alpha").cast("double") * F.col("coverage")
    light = lambda k: F.floor(F.col("rgb")[k].cast("double") * a * F.lit(LIGHT_UNITS) + F.lit(0.5))
    sums = points.groupBy("px", "py").agg(
        *[F.try_sum(light(k)).alias(f"_{c}") for k, c in enumerate("rgb")], F.count(F.lit(1)).alias("n_points")
    )
    one = F.lit(1.0)
    return sums.select(
        "px",
        "py",
        *[F.least(one, F.coalesce(F.col(f"_{c}").cast("double") / F.lit(LIGHT_UNITS), one)).alias(c) for c in "rgb"],
        "n_points",
    )


def render(
    df: DataFrame,
    camera: Camera | None = None,
    viewport: Viewport = Viewport(),
    *,
    point_size: float = DEFAULT_POINT_SIZE,
    opacity: float = DEFAULT_OPACITY,
    z_cutoff: float = DEFAULT_Z_CUTOFF,
    hidden: set[int] | frozenset[int] = frozenset(),
) -> DataFrame:
    """E3 end to end: visible points -> colour -> project -> splat -> image."""
    from skycat.operators.dims import color_points

    vis = visible_points(df.select("x", "y", "z_cart", "tracer", "z"), z_cutoff=z_cutoff, hidden=hidden)
    colored = color_points(vis).withColumn("alpha", F.lit(float(opacity)))
    proj = project_points(colored, camera, viewport, point_size=point_size)
    return density_image(splat(proj, viewport), viewport)
