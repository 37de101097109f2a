"""Geometry and text functions callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import overlay


def register(spark: SparkSession) -> list[str]:
    """Registers the overlay functions; they take the parts of geometries. Returns their names."""
    functions = {"ll_symdiff_m2": overlay.symdiff_m2, "ll_overlap_degrees": overlay.overlap_degrees, "ll_crosses_itself": overlay.crosses_itself}
    for name, f in functions.items():
        spark.udf.register(name, f)
    return sorted(functions)
