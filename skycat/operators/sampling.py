"""Sampling, ordering and generation: W1-W5.

W1 draws, per stratum, n = min(target, available) rows without replacement,
with probability proportional to a clipped weight (uniform when the weights
sum to nothing).  Successive weighted draws without replacement have the same
distribution as keeping the n smallest keys k = -ln(u) / w
(Efraimidis-Spirakis), so the sample is "n smallest keys per stratum", with u
a hash of (seed, row identity): the same rows for any partitioning, file
order, retry or executor loss.

Physical plan, for any size of catalogue and any skew between strata:

1. statistics per stratum (partial aggregation; one row per stratum back to
   the driver): rows, positive weights, sum w and sum w^2 of the clipped
   weights;
2. a key cutoff per stratum, computed on the driver so that at least
   T = n + 8 sqrt(n) + 20 rows are expected below it.  A row passes with
   p = 1 - exp(-w c) (weighted) or p = c (uniform), and
   sum(1 - exp(-w c)) >= c sum(w) - c^2 sum(w^2) / 2, so the smaller root of
   that quadratic is a safe cutoff and the expected survivors are ~T, whatever
   the size of the catalogue.  Where the weights are too concentrated for the
   bound, one aggregation of mergeable quantile sketches (KLL) of the keys gives
   the cutoff, a little above the T-th smallest key; it works on ranks alone, so
   any positive weights will do;
3. a narrow filter ``key <= cutoff`` keeps those rows, which are counted (a
   stratum that fell short is redone with a larger cutoff) and ranked exactly
   by a range-partitioned global order whose positions come from per-partition
   offsets.

No step sorts or shuffles the whole catalogue, and no task ranks more than a
range partition of the survivors, whatever the sample size, the weights or the
skew between strata.  Only the cutoff is probabilistic; the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.functions.hashing import DEFAULT_METHOD, identity, uniform
from skycat.schema import RANDOM_SPREAD, SAMPLE_SEED

import math

# Items a quantile sketch keeps, and the rank error it then has (four times its 99 % bound).
SKETCH_ITEMS = 32768
SKETCH_ERROR = 4 * 2.3 / SKETCH_ITEMS**0.9723


@dataclass(frozen=True)
class StratumPlan:
    stratum: int
    available: int
    n: int
    weighted: bool
    cutoff: float | None = None
    wsum: float = 0.0
    wsum2: float = 0.0
    n_pos: int = 0

    @property
    def want(self) -> float:
        """Expected survivors to aim for: n plus eight standard deviations."""
        return self.n + 8.0 * math.sqrt(self.n) + 20.0


def _ident(id_cols) -> Column:
    if isinstance(id_cols, str):
        id_cols = [id_cols]
    return identity(*id_cols)


def clipped_weight(weight) -> Column:
    """Negative -> 0 (NaN stays NaN: Spark's greatest(NaN, 0) is NaN anyway)."""
    w = (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    return F.when(w < 0, F.lit(0.0)).otherwise(w)


def sample_key(u: Column, w: Column | None) -> Column:
    """-ln(u)/w for weighted strata, u itself for uniform ones (both ascending)."""
    if w is None:
        return u
    return -F.log(u) / w


def _case(stratum: Column, values: dict, default=None) -> Column:
    expr = None
    for k, v in values.items():
        expr = F.when(stratum == k, v) if expr is None else expr.when(stratum == k, v)
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def plan_strata(
    df: DataFrame, targets: dict[int, int], stratum: str, weight: str | None, exhaust: bool = False
) -> list[StratumPlan]:
    """Step 1: one small aggregation; decides weighted/uniform and raises like numpy."""
    wc = clipped_weight(weight) if weight else F.lit(1.0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    stats = (
        df.where(F.col(stratum).isin(list(targets)))
        .groupBy(stratum)
        .agg(
            F.count(F.lit(1)).alias("available"),
            F.sum(F.when(F.isnan(wc), F.lit(0.0)).otherwise(wc)).alias("wsum"),
            F.sum(F.when(F.isnan(wc), F.lit(0.0)).otherwise(wc * wc)).alias("wsum2"),
            F.count_if(F.isnan(w)).alias("n_nan"),
            F.count_if(w == F.lit(float("inf"))).alias("n_inf"),
            F.count_if(wc > 0).alias("n_pos"),
        )
        .collect()
    )
    plans = []
    for r in sorted(stats, key=lambda r: r[stratum]):
        t, avail = r[stratum], r["available"]
        n = min(int(targets[t]), int(avail))
        if n <= 0:
            continue
        # The sum is NaN when any weight is NaN (then "sum > 0" is false: uniform)
        # and +inf when any weight is +inf (probabilities become NaN: error).
        weighted = weight is not None and r["n_nan"] == 0 and (r["n_inf"] > 0 or r["wsum"] > 0)
        if exhaust and n == avail:  # all rows are taken: nothing is drawn
            weighted = False
        if weighted and r["n_inf"] > 0:
            raise ValueError(f"stratum {t}: {r['n_inf']} infinite weight(s); probabilities are undefined")
        if weighted and r["n_pos"] < n:
            raise ValueError(
                f"stratum {t}: only {r['n_pos']} positive weights for a sample of {n} without replacement"
            )
        plans.append(
            _with_cutoff(StratumPlan(t, int(avail), n, weighted, None, float(r["wsum"] or 0.0), float(r["wsum2"] or 0.0), int(r["n_pos"])))
        )
    return plans


def _with_cutoff(p: StratumPlan) -> StratumPlan:
    """Analytic cutoff (None: the stratum has at most ``want`` rows, all are kept; nan: needs the sketch)."""
    from dataclasses import replace

    rows = p.n_pos if p.weighted else p.available
    if p.want >= rows:
        return p
    if not p.weighted:
        return replace(p, cutoff=p.want / rows)
    disc = p.wsum * p.wsum - 2.0 * p.wsum2 * p.want
    if not 0 <= disc < math.inf:  # concentrated weights, or squares beyond the largest double
        return replace(p, cutoff=float("nan"))
    return replace(p, cutoff=2.0 * p.want / (p.wsum + math.sqrt(disc)))


def _scaled(c: float, exponent: int) -> float:
    """c * 2^exponent; beyond the largest double: infinity."""
    try:
        return math.ldexp(c, exponent)
    except OverflowError:
        return math.inf


def _sketch_cutoffs(
    df: DataFrame, plans: list[StratumPlan], stratum: str, weight: str, ident: Column, seed: int, method: str = DEFAULT_METHOD
) -> list[StratumPlan]:
    """For strata whose weights defeat the moment bound: a key quantile that at least ``want`` rows
    do not exceed, from one aggregation of mergeable sketches (one row per stratum comes back)."""
    from dataclasses import replace

    need = [p for p in plans if p.cutoff is not None and math.isnan(p.cutoff)]
    if not need:
        return plans
    ranks = [min(1.0, p.want / p.n_pos + SKETCH_ERROR) for p in need]
    keyed = _keyed(df, need, stratum, weight, ident, seed, method)
    sketch = keyed.groupBy(stratum).agg(F.kll_sketch_agg_double("_key", SKETCH_ITEMS).alias("sketch"))
    # the rank must be a literal: each stratum takes its own of all strata's
    rows = sketch.select(stratum, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(r) for r in ranks])).alias("q")).collect()
    found = {r[stratum]: r["q"] for r in rows}
    cut = {p.stratum: found[p.stratum][k] for k, p in enumerate(need)}
    return [replace(p, cutoff=cut.get(p.stratum, p.cutoff)) for p in plans]


def _keyed(
    df: DataFrame, plans: list[StratumPlan], stratum: str, weight: str | None, ident: Column, seed: int, method: str = DEFAULT_METHOD
) -> DataFrame:
    u = uniform(f"{seed}:key", ident, method)
    weighted = [p.stratum for p in plans if p.weighted]
    s = F.col(stratum)
    out = df.where(s.isin([p.stratum for p in plans]))
    if weighted:
        wc = clipped_weight(weight)
        # zero-weight rows of weighted strata can never be drawn
        out = out.where(~s.isin(weighted) | (wc > 0))
        key = F.when(s.isin(weighted), sample_key(u, wc)).otherwise(u)
    else:
        key = u
    return out.withColumns({"_key": key, "_ident": ident})


def weighted_stratified_sample(
    df: DataFrame,
    targets: dict[int, int],
    *,
    id_cols=("catalog", "row_index"),
    weight: str | None = "weight",
    stratum: str = "tracer",
    seed: int = SAMPLE_SEED,
    stats_out: list | None = None,
    hash_method: str = DEFAULT_METHOD,
    exhaust: bool = False,
) -> DataFrame:
    """Per stratum min(target, available) rows, drawn without replacement
    with probability proportional to max(weight, 0).

    * strata with no rows, or absent from ``targets``, are left out;
    * a stratum whose weights sum to nothing (or hold a NaN) is sampled uniformly;
    * an infinite weight, or fewer positive weights than n, raises ValueError;
    * with ``exhaust`` a stratum that holds no more rows than its target gives
      them all, whatever their weights.

    The output has the input's columns; row identity (``id_cols``) must be
    unique, since it decides the random key of each row.  ``stats_out``, if
    given, receives the per-stratum plans (rows available, n, mode).
    ``hash_method`` "md5" has a SQL twin, at four times the cost of a key.
    """
    ident = _ident(id_cols)
    plans = plan_strata(df, targets, stratum, weight, exhaust)
    if weight:
        plans = _sketch_cutoffs(df, plans, stratum, weight, ident, seed, hash_method)
    if stats_out is not None:
        stats_out.extend(plans)
    if not plans:
        return df.where(F.lit(False))
    s = F.col(stratum)
    # a stratum asking for all its rows keeps them all: no keys, no ranking
    whole = [p.stratum for p in plans if p.n >= p.available]
    kept = df.where(s.isin(whole)) if whole else None
    plans = [p for p in plans if p.n < p.available]
    if not plans:
        return kept
    keyed = _keyed(df, plans, stratum, weight, ident, seed, hash_method)
    cut = {p.stratum: p.cutoff for p in plans if p.cutoff is not None}
    for again in range(12):  # 2^(1 + 2 + 4 + ...) spans all doubles
        low = ~s.isin(list(cut)) | (F.col("_key") <= _case(s, {t: F.lit(c) for t, c in cut.items()})) if cut else F.lit(True)
        survivors = keyed.where(low).persist(StorageLevel.MEMORY_AND_DISK)
        counts = {r[stratum]: r["n"] for r in survivors.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()} if cut else {}
        short = [p.stratum for p in plans if p.stratum in cut and counts.get(p.stratum, 0) < p.n]
        if not short:
            break
        survivors.unpersist()  # fell short of n (about 1e-15 likely): more rows of those strata
        cut.update({t: _scaled(cut[t], 1 << again) if cut[t] > 0 and again < 11 else math.inf for t in short})
    out = _top_n_ranked(survivors, plans, stratum).drop("_key", "_ident")
    survivors.unpersist()  # the ranked rows are checkpointed
    return out if kept is None else kept.unionByName(out)


def _top_n_ranked(survivors: DataFrame, plans: list[StratumPlan], stratum: str) -> DataFrame:
    """n smallest keys per stratum for any n: a range-partitioned global order
    on (stratum, key, identity) numbered by per-partition offsets; a row's rank
    in its stratum is its position minus the stratum's first position.  No
    task holds more than one range partition."""
    s = F.col(stratum)
    ranked = with_position(survivors, [stratum, "_key", "_ident"], "_pos")
    first = {r[stratum]: r["first"] for r in ranked.groupBy(stratum).agg(F.min("_pos").alias("first")).collect()}
    rank = F.col("_pos") - _case(s, {t: F.lit(v) for t, v in first.items()})
    limit = _case(s, {p.stratum: F.lit(p.n) for p in plans})
    return ranked.where(rank < limit).drop("_pos")


def cap_points(
    df: DataFrame, max_points: int, *, id_cols=("catalog", "row_index"), seed: int = SAMPLE_SEED, hash_method: str = DEFAULT_METHOD
) -> DataFrame:
    """Exactly ``max_points`` uniform rows without replacement if there are
    more, else the input unchanged."""
    one = df.withColumn("_stratum", F.lit(0))
    out = weighted_stratified_sample(
        one, {0: max_points}, id_cols=id_cols, weight=None, stratum="_stratum", seed=seed, hash_method=hash_method
    )
    return out.drop("_stratum")


def permutation_key(id_cols=("catalog", "row_index"), seed: int = SAMPLE_SEED, hash_method: str = DEFAULT_METHOD) -> Column:
    return uniform(f"{seed}:perm", _ident(id_cols), hash_method)


def shuffle_points(
    df: DataFrame, *, id_cols=("catalog", "row_index"), seed: int = SAMPLE_SEED, hash_method: str = DEFAULT_METHOD
) -> DataFrame:
    """A reproducible random permutation (a range-partitioned total order on
    a hash key, ties broken by identity).  Sort the sample, not the catalogue."""
    return (
        df.withColumns({"_perm": permutation_key(id_cols, seed, hash_method), "_ident": _ident(id_cols)})
        .orderBy("_perm", "_ident")
        .drop("_perm", "_ident")
    )


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number the rows 0..n-1 in ``order`` without a single-task window.

    Range-partition and sort by ``order``; a row's id within its partition comes
    from ``monotonically_increasing_id`` (partition << 33 | local index).  The
    sorted table is checkpointed (reliably, in the checkpoint folder) so that
    both passes see identical partitions; the per-partition counts (one row per
    partition) are turned into offsets and joined back.
    """
    spark = df.sparkSession
    from skycat.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    sorted_df = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("_mid", 33)
    counts = sorted_df.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, ["_off"])
    out = sorted_df.join(offsets, part == F.col("_pid"), "left")
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("_off") + local).drop("_mid", "_pid", "_off")


def shuffle_with_position(
    df: DataFrame, *, id_cols=("catalog", "row_index"), seed: int = SAMPLE_SEED, hash_method: str = DEFAULT_METHOD
) -> DataFrame:
    """W3 with the permutation position as a column (0-based)."""
    keyed = df.withColumns({"_perm": permutation_key(id_cols, seed, hash_method), "_ident": _ident(id_cols)})
    return with_position(keyed, ["_perm", "_ident"]).drop("_perm", "_ident")


def _in_cube(ident: Column, spread: float, seed: int, method: str) -> dict[str, Column]:
    return {
        c: ((uniform(f"{seed}:{c}", ident, method) - F.lit(0.5)) * F.lit(float(spread))).cast("float")
        for c in ("x", "y", "z_cart")
    }


def random_points(
    df: DataFrame,
    *,
    spread: float = RANDOM_SPREAD,
    id_cols=("catalog", "row_index"),
    seed: int = SAMPLE_SEED,
    hash_method: str = DEFAULT_METHOD,
) -> DataFrame:
    """One uniform point in a cube of side ``spread`` centred on 0 per input
    row (a random comparison catalogue of the same size), reproducible by seed."""
    cols = _in_cube(_ident(id_cols), spread, seed, hash_method)
    return df.select(*[F.col(c) for c in ([id_cols] if isinstance(id_cols, str) else id_cols)], *[v.alias(k) for k, v in cols.items()])


def generated_points(
    spark: SparkSession, n: int, *, spread: float = RANDOM_SPREAD, seed: int = SAMPLE_SEED, hash_method: str = DEFAULT_METHOD
) -> DataFrame:
    """``n`` uniform points (id 0..n-1, x, y, z_cart) in a cube of side ``spread`` centred on 0,
    reproducible by seed; made where they are used, without an input."""
    return random_points(spark.range(n), spread=spread, id_cols="id", seed=seed, hash_method=hash_method)


def split_by_tracer(df: DataFrame, tracers: list[int] | None = None) -> dict[int, DataFrame]:
    """One subset per present tracer (equality filters, pushed into the scan).

    ``tracers`` defaults to the present ones (A5, a distinct over one column).
    """
    if tracers is None:
        tracers = [r["tracer"] for r in df.select("tracer").distinct().orderBy("tracer").collect()]
    return {t: df.where(F.col("tracer") == t) for t in tracers}

