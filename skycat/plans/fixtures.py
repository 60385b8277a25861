"""Raw FITS catalogue files made from the lineitem-derived catalogue
(benchmark and test inputs; the original ships no data).

Each Spark task writes, for every catalogue present in its partition, one
FITS file ``<root>/part-<task>/<catalogue file name>`` holding its rows.  No
catalogue is gathered into one task, so this scales with the input; the
reader then sees many files per catalogue, and rows are identified by
(path, row_index).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from skycat.sources import fsio


def write_fits_catalogs(raw: DataFrame, root: str) -> DataFrame:
    """``raw``: file_name, RA, DEC, Z (double), WEIGHT (float).  Returns one row
    per written file (path, rows); the write happens when it is collected."""

    def write_part(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from skycat.sources.fits import write_fits_table

        pid = TaskContext.get().partitionId()
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        names = t.column("file_name").to_numpy(zero_copy_only=False)
        paths, counts = [], []
        for name in sorted(set(names)):
            idx = np.nonzero(names == name)[0]
            cols = {
                "TARGETID": np.arange(len(idx), dtype=np.int64),
                "RA": t.column("RA").to_numpy()[idx].astype(np.float64),
                "DEC": t.column("DEC").to_numpy()[idx].astype(np.float64),
                "Z": t.column("Z").to_numpy()[idx].astype(np.float64),
                "WEIGHT": t.column("WEIGHT").to_numpy()[idx].astype(np.float32),
            }
            path = fsio.join(fsio.join(root, f"part-{pid:05d}"), name)
            write_fits_table(path, cols)
            paths.append(path)
            counts.append(len(idx))
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64())], names=["path", "rows"])

    from skycat.session import ship_package

    ship_package(raw.sparkSession)
    return raw.select("file_name", "RA", "DEC", "Z", "WEIGHT").mapInArrow(write_part, "path string, rows bigint")
