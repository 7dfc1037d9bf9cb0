"""Semi and anti joins that stay balanced when one key has very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str, spread_by: list[str], salts: int | None = None) -> DataFrame:
    """Rows with (``left_semi``) or without (``left_anti``) a partner in ``keys``.

    Spark measures the partitions of ``rows`` as they are shuffled and splits
    those that a hot key makes large, each part with its partition of the keys;
    keys are copied for no other. Where that is switched off, or ``salts`` are
    given, rows of one key are spread over so many tasks by a hash of
    ``spread_by`` instead, and all keys are repeated once per salt. The hash
    depends on content only, so a recomputed task deals its rows the same way.
    """
    conf = rows.sparkSession.conf
    keys = keys.select(*on).distinct()
    if salts is None:
        if all(conf.get(f"spark.sql.adaptive.{name}") == "true" for name in ("enabled", "skewJoin.enabled")):
            return rows.join(keys, on, how)
        salts = max(2, int(conf.get("spark.sql.shuffle.partitions")) // 10)
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).select(*rows.columns)
