"""skycat: galaxy-survey clustering catalogues on Spark.

DataFrame in, DataFrame out: ``functions`` (Column expressions), ``operators``
(DataFrame transformations), ``sources`` (FITS and packed-point data sources,
Parquet and metadata sinks), ``plans`` (end-to-end chains), ``streaming``
(incremental ingest).
"""
