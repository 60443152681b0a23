"""The functions of the containment index as temporary SQL functions, so that they can be called from spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewater.operators.sketch import PRIME

FUNCTIONS = {
    "min_hash_char(v STRING, i INT)": f"RETURNS BIGINT RETURN (((CAST(i AS BIGINT) * 2654435 + 40503) % {PRIME} + 1) * CAST(conv(substring(md5(CAST(v AS BINARY)), 1, 7), 16, 10) AS BIGINT) + (CAST(i AS BIGINT) * 97531 + 12345) % {PRIME}) % {PRIME}",
    "check_hash_keys(a ARRAY<BIGINT>, b ARRAY<BIGINT>, n INT)": "RETURNS BOOLEAN RETURN slice(a, 1, n) = slice(b, 1, n)",
    "jaccard_of(a ARRAY<STRING>, b ARRAY<STRING>)": "RETURNS DOUBLE RETURN CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END",
    "domain_of(s STRING, t STRING, c STRING)": "RETURNS STRING RETURN concat('schema: ', s, ' table_name: ', t, ' col_name: ', c)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates or replaces the functions; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]
