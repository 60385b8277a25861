"""W1-W5 properties and the numpy-compatible edge cases (FIXTURES §3)."""

import math

import pytest
from pyspark.sql import functions as F

from skycat.operators import sampling


def _cat(spark, rows):
    return spark.createDataFrame(rows, "id string, tracer short, weight float")


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_exact_size_unique_subset_and_zero_weights_absent(spark):
    rows = [(f"r{i}", i % 3, float(i % 5)) for i in range(3000)]  # weights 0..4, some zero
    df = _cat(spark, rows)
    out = sampling.weighted_stratified_sample(df, {0: 100, 1: 250, 2: 10}, id_cols="id")
    got = out.collect()
    by = {}
    for r in got:
        by.setdefault(r.tracer, []).append(r)
    assert {t: len(v) for t, v in by.items()} == {0: 100, 1: 250, 2: 10}
    assert len({r.id for r in got}) == len(got)
    assert all(r.weight > 0 for r in got)
    assert set(out.columns) == set(df.columns)


def test_same_rows_for_any_partitioning(spark):
    rows = [(f"r{i}", i % 2, 0.5 + (i % 7)) for i in range(4000)]
    a = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 300, 1: 120}, id_cols="id")
    b = sampling.weighted_stratified_sample(_cat(spark, rows[::-1]).repartition(13), {0: 300, 1: 120}, id_cols="id")
    assert _ids(a) == _ids(b)


def test_matches_plain_row_number_oracle(spark):
    rows = [(f"r{i}", i % 2, 0.1 + (i % 9)) for i in range(5000)]
    df = _cat(spark, rows)
    got = _ids(sampling.weighted_stratified_sample(df, {0: 200, 1: 400}, id_cols="id"))
    from pyspark.sql import Window

    from skycat.functions.hashing import identity, uniform

    key = -F.log(uniform("42:key", identity("id"))) / F.col("weight").cast("double")
    w = Window.partitionBy("tracer").orderBy(key, "id")
    lim = F.when(F.col("tracer") == 0, 200).otherwise(400)
    want = _ids(df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= lim))
    assert got == want


def test_inclusion_frequency_increases_with_weight(spark):
    rows = [(f"r{i}", 0, float(1 + i % 4)) for i in range(8000)]
    out = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 1000}, id_cols="id")
    counts = {r.weight: r.n for r in out.groupBy("weight").agg(F.count("*").alias("n")).collect()}
    assert counts[1.0] < counts[2.0] < counts[3.0] < counts[4.0]


def test_all_zero_weights_is_uniform(spark):
    rows = [(f"r{i}", 0, 0.0) for i in range(500)]
    out = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 50}, id_cols="id")
    assert out.count() == 50


def test_nan_weight_makes_stratum_uniform(spark):
    rows = [(f"r{i}", 0, float("nan") if i == 0 else 0.0 if i % 2 else 1.0) for i in range(400)]
    out = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 300}, id_cols="id")
    got = out.collect()
    assert len(got) == 300
    assert any(r.weight == 0.0 for r in got)  # uniform: zero weights can be drawn


def test_negative_weights_are_zero(spark):
    rows = [(f"r{i}", 0, -1.0 if i < 100 else 1.0) for i in range(300)]
    out = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 150}, id_cols="id")
    assert all(r.weight > 0 for r in out.collect())


def test_fewer_positive_weights_than_n_raises(spark):
    rows = [(f"r{i}", 0, 1.0 if i < 10 else 0.0) for i in range(100)]
    with pytest.raises(ValueError, match="positive weights"):
        sampling.weighted_stratified_sample(_cat(spark, rows), {0: 20}, id_cols="id")


def test_available_below_target_with_zero_weight_raises(spark):
    rows = [(f"r{i}", 0, 0.0 if i == 0 else 1.0) for i in range(30)]
    with pytest.raises(ValueError):
        sampling.weighted_stratified_sample(_cat(spark, rows), {0: 100}, id_cols="id")


def test_exhausted_stratum_gives_all_rows(spark):
    rows = [(f"r{i}", 0, float(i % 3)) for i in range(30)] + [(f"s{i}", 1, float(i % 3)) for i in range(90)]
    out = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 30, 1: 40}, id_cols="id", exhaust=True).collect()
    assert sorted(r.id for r in out if r.tracer == 0) == sorted(r[0] for r in rows if r[1] == 0)
    drawn = [r for r in out if r.tracer == 1]
    assert len(drawn) == 40 and all(r.weight > 0 for r in drawn)
    with pytest.raises(ValueError, match="positive weights"):
        sampling.weighted_stratified_sample(_cat(spark, rows), {1: 70}, id_cols="id", exhaust=True)


def test_extreme_weights_take_one_pass_less(spark, monkeypatch):
    """Weights over all doubles: one sketch job finds every cutoff, and the sample is exact."""
    rows = [(f"r{i}", i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, tracer short")
    level = (F.substring("id", 2, 9).cast("int") / 2).cast("int") % 50
    weight = F.when(level == 0, 1e305).when(level < 10, 1e100).when(level < 30, 1.0).otherwise(1e-305)
    df = df.withColumn("weight", weight)
    plans = sampling.plan_strata(df, {0: 500, 1: 2000}, "tracer", "weight")
    assert all(math.isnan(p.cutoff) for p in plans)
    got = _ids(sampling.weighted_stratified_sample(df, {0: 500, 1: 2000}, id_cols="id"))
    assert len(got) == 2500 and got == _oracle_ids(df, {0: 500, 1: 2000})


def test_generated_points(spark):
    """3,000 points in a cube of side 8: reproducible, inside, uniform; the same on any partitioning."""
    a = sampling.generated_points(spark, 3000, spread=8.0, seed=7)
    rows = sorted((r.id, r.x, r.y, r.z_cart) for r in a.collect())
    assert [r[0] for r in rows] == list(range(3000))
    assert rows == sorted((r.id, r.x, r.y, r.z_cart) for r in sampling.random_points(spark.range(3000).repartition(5), spread=8.0, id_cols="id", seed=7).collect())
    for axis in (1, 2, 3):
        v = [r[axis] for r in rows]
        assert -4 <= min(v) < -3.9 and 3.9 < max(v) <= 4 and abs(sum(v) / 3000) < 0.2
    assert rows != sorted((r.id, r.x, r.y, r.z_cart) for r in sampling.generated_points(spark, 3000, spread=8.0, seed=8).collect())


def test_infinite_weight_raises(spark):
    rows = [(f"r{i}", 0, float("inf") if i == 0 else 1.0) for i in range(30)]
    with pytest.raises(ValueError, match="infinite"):
        sampling.weighted_stratified_sample(_cat(spark, rows), {0: 5}, id_cols="id")


def test_absent_and_untargeted_strata_left_out(spark):
    rows = [(f"r{i}", i % 2, 1.0) for i in range(100)]
    out = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 10, 3: 10}, id_cols="id")
    assert {r.tracer for r in out.collect()} == {0}


def test_cap_points(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    assert sampling.cap_points(df, 1500, id_cols="id").count() == 1000
    assert sampling.cap_points(df, 1000, id_cols="id").count() == 1000
    capped = sampling.cap_points(df, 300, id_cols="id")
    assert capped.count() == 300 and capped.distinct().count() == 300


def test_shuffle_is_a_permutation_with_positions(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id")).repartition(5)
    out = sampling.shuffle_with_position(df, id_cols="id").collect()
    assert sorted(r.position for r in out) == list(range(3000))
    assert sorted(r.id for r in out) == sorted(str(i) for i in range(3000))
    order = [r.id for r in sorted(out, key=lambda r: r.position)]
    plain = [r.id for r in sampling.shuffle_points(df, id_cols="id").collect()]
    assert order == plain
    assert order != sorted(order)


def test_random_points_in_cube(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    pts = sampling.random_points(df, spread=8.0, id_cols="id").collect()
    assert len(pts) == 2000
    assert all(-4 <= p.x <= 4 and -4 <= p.y <= 4 and -4 <= p.z_cart <= 4 for p in pts)


def test_split_by_tracer(spark):
    df = spark.createDataFrame([(t,) for t in [0, 0, 1, 3]], "tracer short")
    parts = sampling.split_by_tracer(df)
    assert sorted(parts) == [0, 1, 3] and parts[0].count() == 2


def test_ranking_is_the_same_on_any_partitioning(spark):
    rows = [(f"r{i}", i % 3, 0.25 + (i % 11)) for i in range(6000)]
    df = _cat(spark, rows)
    t = {0: 500, 1: 1999, 2: 40}
    a = _ids(sampling.weighted_stratified_sample(df, t, id_cols="id"))
    b = _ids(sampling.weighted_stratified_sample(df.repartition(9), t, id_cols="id"))
    assert a == b == _oracle_ids(df, t) and len(a) == sum(t.values())


@pytest.mark.parametrize("heavy", [3e38, 1e300])
def test_one_huge_weight_still_gets_a_cutoff(spark, heavy):
    rows = [(f"r{i}", i % 2, heavy if i < 2 else 1.0 + i % 7) for i in range(4000)]
    df = _cat(spark, rows).withColumn("weight", F.lit(None).cast("double"))
    df = df.withColumn("weight", F.when(F.col("id").isin("r0", "r1"), F.lit(heavy)).otherwise(F.substring("id", 2, 9).cast("double") % 7 + 1.0))
    plans = sampling.plan_strata(df, {0: 50, 1: 50}, "tracer", "weight")
    plans = sampling._sketch_cutoffs(df, plans, "tracer", "weight", F.col("id"), 42)
    keyed = sampling._keyed(df, plans, "tracer", "weight", F.col("id"), 42)
    for p in plans:
        assert 0 < p.cutoff < math.inf
        below = keyed.where((F.col("tracer") == p.stratum) & (F.col("_key") <= p.cutoff)).count()
        assert p.want - 1 <= below <= p.want + 2 * sampling.SKETCH_ERROR * p.n_pos + 2
    got = _ids(sampling.weighted_stratified_sample(df, {0: 50, 1: 50}, id_cols="id"))
    assert got == _oracle_ids(df, {0: 50, 1: 50}) and {"r0", "r1"} <= set(got)


def test_nothing_stays_cached(spark):
    df = _cat(spark, [(f"r{i}", 0, 1.0) for i in range(2000)])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    sampling.weighted_stratified_sample(df, {0: 20}, id_cols="id").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def _oracle_ids(df, targets):
    from pyspark.sql import Window

    from skycat.functions.hashing import identity, uniform

    key = -F.log(uniform("42:key", identity("id"))) / F.col("weight").cast("double")
    lim = F.lit(None)
    for t, n in targets.items():
        lim = F.when(F.col("tracer") == t, n).otherwise(lim)
    w = Window.partitionBy("tracer").orderBy(key, "id")
    return _ids(df.where(F.col("weight") > 0).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= lim))


def test_concentrated_weights_use_the_sketch_and_stay_exact(spark):
    rows = [(f"r{i}", 0, 1000.0 if i < 20 else 0.001) for i in range(3000)]
    df = _cat(spark, rows)
    plans = sampling.plan_strata(df, {0: 100}, "tracer", "weight")
    assert math.isnan(plans[0].cutoff)
    plans = sampling._sketch_cutoffs(df, plans, "tracer", "weight", F.col("id"), 42)
    assert plans[0].cutoff > 0
    got = _ids(sampling.weighted_stratified_sample(df, {0: 100}, id_cols="id"))
    assert got == _oracle_ids(df, {0: 100})
    assert sum(1 for i in got if int(i[1:]) < 20) == 20  # the heavy rows are always drawn


def test_survivors_do_not_grow_with_catalogue(spark):
    small = sampling._with_cutoff(sampling.StratumPlan(0, 10_000, 1000, True, None, 10_000.0, 10_000.0, 10_000))
    big = sampling._with_cutoff(sampling.StratumPlan(0, 10**11, 1000, True, None, 1e11, 1e11, 10**11))
    # expected survivors sum(1 - exp(-w c)), here all w = 1: about n + 8 sqrt(n) + 20 for both
    e_small = 10_000 * -math.expm1(-small.cutoff)
    e_big = 1e11 * -math.expm1(-big.cutoff)
    for e in (e_small, e_big):
        assert small.want <= e < 1.05 * small.want


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_inclusion_probabilities_match_successive_draws(spark, method):
    """Keeping the 2 smallest -ln(u)/w of 4 items draws like numpy's choice
    without replacement: P(i) = p_i + sum_j p_j p_i / (1 - p_j)."""
    from pyspark.sql import Window

    from skycat.functions.hashing import identity, uniform

    w = [1.0, 2.0, 3.0, 4.0]
    p = [x / sum(w) for x in w]
    exact = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(4) if j != i) for i in range(4)]
    trials = 4000
    df = spark.range(trials * 4).select(
        (F.col("id") / 4).cast("long").alias("trial"), (F.col("id") % 4).cast("int").alias("item")
    ).withColumn("w", F.element_at(F.array(*[F.lit(x) for x in w]), F.col("item") + 1))
    key = -F.log(uniform("42:key", identity("trial", "item"), method)) / F.col("w")
    top = df.withColumn("rk", F.row_number().over(Window.partitionBy("trial").orderBy(key))).where("rk <= 2")
    freq = {r.item: r.n / trials for r in top.groupBy("item").agg(F.count("*").alias("n")).collect()}
    for i in range(4):
        sd = math.sqrt(exact[i] * (1 - exact[i]) / trials)
        assert abs(freq[i] - exact[i]) < 4 * sd, (i, freq[i], exact[i])


def test_xxhash64_keys(spark):
    rows = [(f"r{i}", i % 2, 0.5 + (i % 7)) for i in range(4000)]
    a = sampling.weighted_stratified_sample(_cat(spark, rows), {0: 300, 1: 120}, id_cols="id", hash_method="xxhash64")
    b = sampling.weighted_stratified_sample(_cat(spark, rows[::-1]).repartition(7), {0: 300, 1: 120}, id_cols="id", hash_method="xxhash64")
    ids = _ids(a)
    assert ids == _ids(b) and len(ids) == 420 and len(set(ids)) == 420
    assert ids != _ids(sampling.weighted_stratified_sample(_cat(spark, rows), {0: 300, 1: 120}, id_cols="id", hash_method="md5"))
    with pytest.raises(ValueError):
        sampling.shuffle_points(_cat(spark, rows), id_cols="id", hash_method="sha0")
