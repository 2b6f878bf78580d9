"""Sharding by an external shuffle in two passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, drop_dir, shared_dir, stored, text_of

SHARDS, SEED, BUCKET_BYTES = 24, 20_240_607, 48 << 20


CHANGED = "docs changed between passes"


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes docs in random order as `shards` shards and returns (the table read back, its path).

    Pass 1 scatters rows into buckets by a seeded hash of doc_id and text (of the row's place where doc_id is null): buckets
    are so many that each has about bucket_bytes of text. Pass 2 sorts a bucket by that hash, so that its start doesn't
    depend on the order of arrival, shuffles it by Fisher-Yates with a generator seeded for that bucket, and writes it. The
    buckets' counts give every row its place in the whole order; shard s has the places from ceil(s * n / shards) on, so
    counts differ by one at most, and slots run from 0 without gaps. Equal texts and rows that repeat an id with other
    texts are spread. Rows equal in both share a bucket, unless they are a HOT_KEYS-th of all rows: those (so many kinds
    at most) are spread by their places, and their order then depends on the partitions of docs, as does that of rows
    without id. Null texts are kept and count no bytes; a very long text makes its bucket as large as it is. Columns called
    shard and slot are replaced, others kept. Places need docs to be split alike in both passes, as a stored table is; where
    the second finds otherwise, docs are written to the shared folder, and both are run on that.
    """
    try:
        return _shuffled(docs, shards, seed, bucket_bytes, id_col, text_col)
    except Exception as e:
        if CHANGED not in str(e):
            raise
    kept, folder = stored(docs, "unsharded")
    out = _shuffled(kept, shards, seed, bucket_bytes, id_col, text_col)
    drop_dir(docs.sparkSession, folder)
    return out


def _shuffled(docs: DataFrame, shards: int, seed: int, bucket_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    spark = docs.sparkSession
    rows = docs.drop("shard", "slot")
    place = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    own = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), place), text_of(text_col))
    sums = rows.select(F.octet_length(text_of(text_col)).cast("long").alias("n")).agg(F.sum("n"), F.count("*")).first()
    n_bytes, total = sums[0] or 0, sums[1]
    buckets = max(1, -(-n_bytes // bucket_bytes))
    alike = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text_of(text_col))
    often = rows.filter(F.col(id_col).isNotNull()).groupBy(alike.alias("t")).count().filter(F.col("count") >= max(total // HOT_KEYS, 1000))
    hot = [r[0] for r in often.select("t").collect()]  # at most HOT_KEYS
    ticket = F.when(own.isin(hot), F.xxhash64(own, place)).otherwise(own) if hot else own
    keyed = rows.withColumn("__ticket", ticket).withColumn("__bucket", F.pmod("__ticket", F.lit(buckets)).cast("int"))
    counts = np.zeros(buckets, np.int64)
    for b, n in keyed.groupBy("__bucket").count().collect():  # one row for each bucket, that is for each bucket_bytes
        counts[b] = n
    starts = np.array([-(-s * total // shards) for s in range(shards + 1)], dtype=np.int64)
    known = spark.sparkContext.broadcast((counts, np.cumsum(counts) - counts))  # 16 bytes for each bucket_bytes of text
    names = [f.name for f in rows.schema]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def emit():
            table = pa.Table.from_batches(held).combine_chunks()
            bucket = table.column("__bucket")[0].as_py()
            counted, base = known.value
            if table.num_rows != counted[bucket]:
                raise RuntimeError(f"bucket {bucket} has {table.num_rows} rows, counted {counted[bucket]}: {CHANGED}")
            order = np.arange(table.num_rows)
            np.random.default_rng([seed, bucket]).shuffle(order)  # Fisher-Yates
            place = base[bucket] + np.arange(table.num_rows, dtype=np.int64)
            shard = np.searchsorted(starts, place, side="right") - 1
            table = table.select(names).take(pa.array(order))
            table = table.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(place - starts[shard]))
            yield from table.to_batches(max_chunksize=1024)

        for b in batches:
            cuts = np.flatnonzero(np.diff(b.column(b.schema.names.index("__bucket")).to_numpy())) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if held and held[-1].column("__bucket")[-1] != b.column("__bucket")[int(lo)]:
                    yield from emit()
                    held = []
                if hi > lo:
                    held.append(b.slice(int(lo), int(hi - lo)))
        if held:
            yield from emit()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    path = shared_dir(spark, "shards")
    dealt = keyed.repartitionById(buckets, F.col("__bucket")).sortWithinPartitions("__bucket", "__ticket", id_col, text_col)
    dealt.mapInArrow(run, f"{schema}, shard int, slot long").write.partitionBy("shard").parquet(path)
    return spark.read.schema(f"{schema}, slot long, shard int").parquet(path), path
