"""What the operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.loop import drop_dir, shared_dir, shuffles_freed, stored, stored_seen

#: The characters that separate words and are stripped from lines: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()


def text_of(column: str) -> Column:
    """The text; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: At most so many keys can each have a share of 1 / HOT_KEYS of all rows, whatever the rows.
HOT_KEYS = 2000


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: Column, total: int) -> DataFrame:
    """rows joined with a table of one row for each key, of which n says how many of the `total` rows have that key.

    Keys with a share of 1 / HOT_KEYS or more are at most HOT_KEYS, whatever the size, so their part of the table is
    broadcast and their rows stay where they are; all others are joined by a shuffle in which no key is large."""
    hot = table.filter(n * HOT_KEYS >= total)
    cold = table.filter(n * HOT_KEYS < total).hint("merge")
    names = hot.select(F.col(key).alias("__hot"))
    rest = rows.join(F.broadcast(names), F.col(key) == F.col("__hot"), "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def join_salted(rows: DataFrame, table: DataFrame, key: str, deal: Column, salts: int = 32) -> DataFrame:
    """rows joined with a table of one row for each key, which may be large ones. Keys with a share of 1 / HOT_KEYS of the
    rows or more, at most HOT_KEYS whatever the size, have `salts` copies of their row, and their rows are dealt over these
    by `deal`. rows are read twice, so they are best a stored table."""
    counts = rows.groupBy(key).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in counts.filter(F.col("count") * HOT_KEYS >= max(total, HOT_KEYS * salts)).select(key).collect()]
    if not often:
        return rows.join(table, key)
    hot = F.col(key).isin(often)
    copies = table.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return rows.withColumn("__salt", F.when(hot, F.pmod(deal, F.lit(salts)).cast("int")).otherwise(0)).join(copies, [key, "__salt"]).drop("__salt")


def tidy() -> None:
    """Gives back what a worker has freed. Workers are kept for later stages, and without this each keeps the most it ever
    used, in Arrow's pool and in malloc's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


__all__ = ["BLANKS", "BLANK_BYTES", "HOT_KEYS", "drop_dir", "join_salted", "join_spread", "shared_dir", "shuffles_freed", "stored", "stored_seen", "text_of", "tidy"]
