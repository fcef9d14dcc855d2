"""Operators for preparing training text: de-duplication, scans, packing, indexes, rollups.

Nothing else in the library imports this subpackage; it may be deleted as a whole. General
conventions, stated once:

* A null text counts as an empty one. Rows with a null ``doc_id`` stay in the result; they
  never make another row a copy and are never cut because of one.
* Repeated rows are treated as separate rows with the same id.
* Extra input columns do no harm: operators pick the columns they need by name into fresh
  internal frames. Where an operator returns its input columns as well, an input column that
  has the name of a result column is replaced by the result.
* Intermediate tables are Parquet under ``spark.checkpoint.dir`` (``common.Scratch``).
"""
