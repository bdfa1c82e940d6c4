"""shroud — privacy-first data engineering on Spark DataFrames and streams.

Sub-packages:

* ``functions``  Column-level building blocks (regex masks, type normalising).
* ``operators``  DataFrame -> DataFrame jobs (PII scan, chat batches, admission
  limiter, code facts, schema catalog, data audits).
* ``sources``    readers for the driver tables, text corpora and derived fixtures.
* ``plans``      the registered queries (Spark plan + DuckDB oracle SQL).
* ``streaming``  Structured Streaming versions of masking and admission.
"""

__version__ = "0.1.0"
