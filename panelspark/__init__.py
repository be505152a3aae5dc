"""panelspark: panel analytics and early-warning operators on Spark DataFrames.

Every public operator is a plain ``DataFrame -> DataFrame`` function built
from native Spark expressions, generic over (entity, period, group) column
names so the same code serves domain tables and the driver's test tables.
"""

from panelspark.session import get_session, checkpoint_dir, scratch_path, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "scratch_path", "cut_lineage"]
