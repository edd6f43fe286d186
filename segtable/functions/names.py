"""SQL functions under names that Spark spells otherwise, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, parameters, result, body.
ALIASES = (
    ("strpos", "s STRING, part STRING", "INT", "instr(s, part)"),
    ("to_hex", "n BIGINT", "STRING", "lower(hex(n))"),
    ("array_length", "a ARRAY<STRING>", "INT", "size(a)"),
    ("date_bin", "step INTERVAL DAY TO SECOND, at TIMESTAMP, origin TIMESTAMP", "TIMESTAMP",
     "timestamp_micros(unix_micros(origin) + CAST(floor((unix_micros(at) - unix_micros(origin)) / (extract(DAY FROM step) * 86400000000D + extract(HOUR FROM step) * 3600000000D"
     " + extract(MINUTE FROM step) * 60000000D + extract(SECOND FROM step) * 1000000D)) * (extract(DAY FROM step) * 86400000000 + extract(HOUR FROM step) * 3600000000"
     " + extract(MINUTE FROM step) * 60000000 + CAST(extract(SECOND FROM step) * 1000000 AS BIGINT)) AS BIGINT))"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the aliases as temporary functions of the session; those that exist are replaced."""
    for name, parameters, result, body in ALIASES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [a[0] for a in ALIASES]
