"""vectorlint: spatial data-quality checks expressed as Spark DataFrame jobs.

Geometry lives in ordinary columns (nested coordinate arrays); every rule is
a column expression, an equi-join on grid cells or a grouped aggregate, so the
work is partitioned and shuffled by Spark and needs no native geometry library.
"""

from vectorlint.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
