"""tessera: dataset preparation, profiling, augmentation and modelling as lazy Spark plans.

Every operator is a function ``op(df, **options) -> DataFrame`` built from Spark SQL
expressions, aggregates, joins, windows and ``pyspark.ml``.  Nothing is collected to the
driver except bounded scalars (a handful of statistics or bucket boundaries) that are
needed to build an expression.
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
