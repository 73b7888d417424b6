"""cohortlens: customer-engagement analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a lazy DataFrame built from
built-in Spark expressions, so Catalyst can prune columns, push filters into the
Parquet scan and pick join strategies, and AQE can re-plan at run time.
"""

from cohortlens.config import Params
from cohortlens.sources.tables import Tables

__all__ = ["Params", "Tables"]
