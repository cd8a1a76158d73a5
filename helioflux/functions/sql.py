"""The scalar functions under SQL names, as temporary SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import constants as K

FLOOR = "CASE upper(substr(c, 1, 1)) " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in K.CLASS_FLOORS.items()) + " END"
FUNCTIONS = {
    "class_letter": ("f DOUBLE", "STRING", "CASE WHEN f <= 0 THEN 'A' WHEN floor(log10(f)) >= -4 THEN 'X' WHEN floor(log10(f)) = -5 THEN 'M' WHEN floor(log10(f)) = -6 THEN 'C' WHEN floor(log10(f)) = -7 THEN 'B' ELSE 'A' END"),
    "class_to_flux": ("c STRING", "DOUBLE", f"coalesce(try_cast(nullif(trim(substr(c, 2)), '') AS DOUBLE), CASE WHEN trim(substr(c, 2)) = '' THEN 1.0D END) * {FLOOR}"),
    "class_rank": ("c STRING", "DOUBLE", f"CASE WHEN c <> '' AND instr('{K.LADDER}', upper(substr(c, 1, 1))) > 0 THEN coalesce(instr('{K.LADDER}', upper(substr(c, 1, 1))) - 1 + coalesce(try_cast(nullif(substr(c, 2), '') AS DOUBLE), CASE WHEN substr(c, 2) = '' THEN 1.0D END) / 10, -1.0D) ELSE -1.0D END"),
    "ltt_delta": ("r_au DOUBLE", "DOUBLE", f"(1.0D - r_au) * {K.AU_KM!r}D / {K.C_KM_S!r}D"),
    "match_score": ("s_on DOUBLE, h_on DOUBLE, s_peak DOUBLE, h_peak DOUBLE", "DOUBLE", f"coalesce(0.7D * greatest(0.0D, 1.0D - CASE WHEN s_on >= h_on THEN (s_on - h_on) / {K.LEAD_S!r}D ELSE (h_on - s_on) / {K.LAG_S!r}D END) + CASE WHEN h_peak < s_peak THEN 0.3D ELSE 0.0D END, 0.0D)"),
    "poisson_llr": ("total DOUBLE, n DOUBLE, mu0 DOUBLE", "DOUBLE", "CASE WHEN n > 0 AND mu0 > 0 AND total > n * mu0 THEN total * ln(total / (n * mu0)) - (total - n * mu0) ELSE 0.0D END"),
    "bucket_of": ("t DOUBLE", "BIGINT", f"CAST(floor(t / {K.BUCKET_S!r}D) AS BIGINT)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
