"""Processed catalogue -> weighted sample -> shuffled packed file + metadata.

    scan (S4) -> per-tracer weighted sample (W1) -> counts (A3) -> random
    order (W3) -> packed records (P9, K3) and document (A4, K4)

Only the statistics and the cutoff passes touch the whole catalogue (a few
narrow columns, partial aggregation); everything after works on the sample.
The sample is checkpointed once (to the session's checkpoint folder) because
three outputs read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skycat.functions.hashing import DEFAULT_METHOD
from skycat.operators import sampling, summary
from skycat.schema import SAMPLE_SEED, TARGET_PER_TRACER
from skycat.session import ensure_checkpoint_dir
from skycat.sources import packed


@dataclass
class ExportResult:
    binary: str
    metadata: dict
    sample_summary: DataFrame


def export_web(
    catalog: DataFrame,
    out_dir: str,
    *,
    targets: dict[int, int] | None = None,
    id_cols=("catalog", "row_index"),
    seed: int = SAMPLE_SEED,
    single_file: bool = True,
    hash_method: str = DEFAULT_METHOD,
) -> ExportResult:
    """``single_file``: True writes ``galaxies.bin``, as the viewer reads it; False a
    folder ``galaxies`` of parts, for targets beyond what one file can hold.  A tracer
    with no more rows than its target is exported whole."""
    spark = catalog.sparkSession
    ensure_checkpoint_dir(spark)
    cols = ["x", "y", "z_cart", "z", "tracer", "weight"] + ([id_cols] if isinstance(id_cols, str) else list(id_cols))
    cat = catalog.select(*cols)
    stats: list = []
    smp = sampling.weighted_stratified_sample(
        cat, targets or TARGET_PER_TRACER, id_cols=id_cols, seed=seed, stats_out=stats, hash_method=hash_method, exhaust=True
    )
    smp = smp.checkpoint(eager=True)
    shuffled = sampling.shuffle_points(smp, id_cols=id_cols, seed=seed, hash_method=hash_method)
    binary = f"{out_dir.rstrip('/')}/galaxies.bin" if single_file else f"{out_dir.rstrip('/')}/galaxies"
    packed.write_packed(shuffled, binary, single_file=single_file)
    doc = packed.metadata_document(smp)
    packed.write_metadata(doc, f"{out_dir.rstrip('/')}/metadata.json")
    avail = {p.stratum: p.available for p in stats}
    return ExportResult(binary, doc, summary.sample_summary_from_stats(spark, avail, smp))


def read_export(spark: SparkSession, out_dir: str):
    """E3 input side: (points, metadata) of an export."""
    from skycat.sources.tables import path_exists

    base = out_dir.rstrip("/")
    binary = f"{base}/galaxies.bin" if path_exists(spark, f"{base}/galaxies.bin") else f"{base}/galaxies"
    pts = packed.read_packed(spark, binary)
    meta = packed.read_metadata(spark, f"{out_dir.rstrip('/')}/metadata.json")
    return pts, meta
