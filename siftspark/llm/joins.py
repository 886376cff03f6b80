"""A left join whose keys may be few and heavy, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with more than this share of the rows is heavy; there are at most 1 / HEAVY of them
HEAVY = 1 / 1000


def skew_join(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of ``table(key, value)``, which holds a key once; null where there is none.

    Rows of heavy keys, which one task would get whole, stay where they are: what the table has for them is at most 1000 rows,
    whatever the input, and is broadcast. So do rows without a key, which meet nothing. All other rows are shuffled by the key. ``rows`` is read
    four times at most, so it should be a written table or a cheap scan."""
    keyless = rows.where(F.col(key).isNull()).withColumn(value, F.lit(None).cast(table.schema[value].dataType))
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    most = rows.count() * HEAVY
    heavy = sizes.where(F.col("__n") > most).select(key)
    rows = rows.where(F.col(key).isNotNull())
    if heavy.isEmpty():
        return rows.join(table, key, "left").select(*rows.columns, value).unionByName(keyless)
    hot = F.broadcast(table.join(F.broadcast(heavy), key, "left_semi"))
    kept = [*rows.columns, value]
    on_spot = rows.join(hot, key).select(*kept)
    rest = rows.join(F.broadcast(table.join(F.broadcast(heavy), key, "left_semi").select(key)), key, "left_anti").join(table, key, "left").select(*kept)
    return on_spot.unionByName(rest).unionByName(keyless)


def unused(names: list[str], like: str) -> str:
    """A column name that no column has, in any case of letters."""
    taken = {n.lower() for n in names}
    while like in taken:
        like += "_"
    return like
