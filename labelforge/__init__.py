"""labelforge — report labelling, consensus and evaluation as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a
``Column`` expression builder).  Nothing here holds a global session; callers
pass DataFrames in and get lazy DataFrames back, so Catalyst sees one plan.
"""

from labelforge.session import get_spark, scratch_path, table

__all__ = ["get_spark", "scratch_path", "table"]
