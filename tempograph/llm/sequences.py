"""Training-order materialisation: fixed-stride shards in the order of a keyed permutation."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec
from .common import drop_dir, shared_dir, shuffles_freed, stored, text_of

#: Ids that no UTF-8 text has: they end a document and fill its last sequence.
END, PAD = 255, 254
LENGTH, SHARD_BYTES, KEY, ROUNDS = 512, 16 << 20, 0x5EED, 6
#: Shards are dealt over at most so many tasks; beyond that a task writes a range of them, one after the other.
MAX_WRITERS = 20_000
#: Shards are written in so many ranges, each with a shuffle of its own, so that the disk never holds more than this part of
#: all records beside the ids and the shards; each range reads the ids once more.
PASSES = 2
SPLIT = "docs were split otherwise than when they were counted"
MANIFEST = "shard int, file string, first_slot long, records long, crc32 long"
#: Before the ids of each record: doc_id (the least int64 for null), number of the sequence in its document, ids in use.
HEADER = "<qii"
HEAD_SIZE = struct.calcsize(HEADER)
NULL_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Form:
    """How ids are written: their dtype, the id that ends a document and the one that fills its last sequence."""

    dtype: str = "u1"
    end: int = END
    pad: int = PAD

    @property
    def width(self) -> int:
        return np.dtype(self.dtype).itemsize

    def raw(self, *ids: int) -> bytes:
        return np.array(ids, self.dtype).tobytes()


def form_of(codec: Codec | None) -> Form:
    """That of UTF-8 bytes without a codec; else the codec's ids and two above them, in 16 bits if those hold them."""
    if codec is None:
        return Form()
    n = codec.size
    return Form("<u2" if n + 2 <= 1 << 16 else "<u4", n, n + 1)


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 .. n - 1: a balanced Feistel network on the least even number of bits that hold n, walked
    along its cycle until it falls below n (under four steps on average). Any place is computed alone, either way."""

    n: int
    key: int = KEY
    rounds: int = ROUNDS

    @property
    def half(self) -> int:
        return max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2)

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for r in reversed(range(self.rounds)) if back else range(self.rounds):
            salt = np.uint64((self.key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))
            if back:
                left, right = right ^ (_mix(left + salt) & mask), left
            else:
                left, right = right, left ^ (_mix(right + salt) & mask)
        return left << h | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = np.asarray(x, dtype=np.uint64)
        if x.size and int(x.max()) >= self.n:
            raise ValueError("index outside the permutation")
        with np.errstate(over="ignore"):
            x = self._pass(x, back)
            while (out := x >= np.uint64(self.n)).any():
                x[out] = self._pass(x[out], back)
        return x.astype(np.int64)

    def slot(self, index) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def _filesystem(uri: str):
    """The store of a path, reached from a worker, and the path in it: file, hdfs, s3, gs or abfs."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def counted(n: Column, length: int) -> Column:
    """Sequences that a text's n ids and its end fill."""
    return F.ceil((n + 1) / length).cast("long")


def _scatter(rows: DataFrame, bases: dict[int, tuple[int, int]], order: Permutation, first: int, until: int, per_shard: int, length: int, form: Form) -> DataFrame:
    """(shard, part): the records of slots from `first` to before `until` that a few MB of documents send to one shard,
    compressed as one part."""
    width, last, fill = form.width, form.raw(form.end), form.raw(form.pad)
    stride = HEAD_SIZE + length * width

    def run(batches: Iterator[pa.RecordBatch]):
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3)
        at, most = bases.get(TaskContext.get().partitionId(), (0, 0))
        end = at + most
        records: list[bytes] = []
        taken: list[int] = []

        def parts():
            nonlocal records, taken
            slots = np.array(taken)
            shards, by = slots // per_shard, np.argsort(slots, kind="stable")
            cuts = np.flatnonzero(np.diff(shards[by])) + 1
            out = [(int(shards[g[0]]), pack.compress((slots[g] % per_shard).astype("<u4").tobytes() + b"".join(records[i] for i in g))) for g in np.split(by, cuts)]
            records, taken = [], []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["shard", "part"])

        for b in batches:
            counts = pc.binary_length(b.column(1)).to_numpy().astype(np.int64) // width // length + 1  # with its end, a text fills so many
            total = int(counts.sum())
            if at + total > end:
                raise RuntimeError(SPLIT)
            slots = iter(order.slot(np.arange(at, at + total)).tolist())
            at += total
            for key, data, n in zip(b.column(0).to_pylist(), b.column(1), counts.tolist(), strict=True):
                ids = None
                for k, slot in zip(range(n), slots):
                    if not first <= slot < until:
                        continue
                    if ids is None:
                        ids = data.as_py() + last
                    own = ids[k * length * width : (k + 1) * length * width]
                    used = len(own) // width
                    records.append(struct.pack(HEADER, NULL_ID if key is None else key, k, used) + own + fill * (length - used))
                    taken.append(slot)
                    if len(records) * stride > 8 << 20:
                        yield parts()
        if records:
            yield parts()
        if at != end:
            raise RuntimeError(SPLIT)

    return rows.select("id", "ids").mapInArrow(run, "shard int, part binary")


def _write(parts: DataFrame, path: str, total: int, per_shard: int, stride: int) -> DataFrame:
    """(shard, file, first_slot, records, crc32) of each shard written. A task's parts come sorted by shard, so one shard at
    a time is in its buffer."""

    def run(batches: Iterator[pa.RecordBatch]):
        import zstandard

        unpack, room, filled, shard = zstandard.ZstdDecompressor(), None, 0, None
        store, folder = _filesystem(path)
        store.create_dir(folder, recursive=True)

        def flushed():
            if filled != len(room):
                raise RuntimeError(f"shard {shard} got {filled} of {len(room)} records")
            name, draft = f"{folder}/shard-{shard:06d}.bin", f"{folder}/.draft-{shard:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:  # whole or not at all, whichever attempt of the task comes last
                f.write(memoryview(room).cast("B"))
            store.move(draft, name)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name.rpartition("/")[2]], "first_slot": [shard * per_shard], "records": [len(room)], "crc32": [zlib.crc32(room)]})

        for b in batches:
            for s, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if s != shard:
                    if room is not None:
                        yield flushed()
                    shard, filled = s, 0
                    room = np.zeros((min(per_shard, total - s * per_shard), stride), np.uint8)
                raw = unpack.decompress(part.as_py())
                n = len(raw) // (stride + 4)
                room[np.frombuffer(raw, "<u4", n)] = np.frombuffer(raw, np.uint8, offset=4 * n).reshape(n, stride)
                filled += n
        if room is not None:
            yield flushed()

    return parts.mapInArrow(run, MANIFEST)


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = KEY, path: str | None = None, codec: Codec | None = None, passes: int = PASSES) -> tuple[DataFrame, str, Permutation]:
    """Writes all texts in training order, as the codec's token ids or, without one, as ids of their UTF-8 bytes; returns
    (manifest, folder, permutation). The folder is a new one below `path`, else below the shared folder, and nothing else
    is ever deleted.

    A text's ids and an end are cut into sequences of `length`, the last one filled (form_of tells with what); null and
    empty texts are an end alone. Texts are encoded once: their ids are kept in the shared folder until the shards are
    written. Sequences are numbered along the partitions of those ids (without a codec, of docs), each partition's base
    being the count of those before it (one number for each partition). A Feistel permutation of all numbers gives every
    sequence its slot, and slots are cut into shards of equal records, so record r of shard s is at byte r * stride, and
    slot and document are computed from each other. Shards are written in `passes` ranges, one after the other. The table
    must be split alike whenever it is read, as a stored one is; where a pass finds otherwise, it is written to the shared
    folder, and all are run again on that. A shard is assembled
    in a buffer of shard_bytes, and its file is moved into place when whole. Rows that repeat an id have sequences of their
    own each; other columns are ignored; a very long text is as many sequences as it fills.
    """
    spark, form, kept = docs.sparkSession, form_of(codec), []
    path = f"{path.rstrip('/')}/sequences-{uuid.uuid4().hex[:12]}" if path else shared_dir(spark, "sequences")
    stride = HEAD_SIZE + length * form.width
    per_shard = max(1, shard_bytes // stride)

    def keep(rows: DataFrame) -> DataFrame:
        rows, folder = stored(rows, "sequenced", compression="zstd")
        kept.append(folder)
        return rows

    try:
        if codec is None:
            data = text_of(text_col).cast("binary")
            rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(data).cast("long").alias("n"), data.alias("ids"))
        else:
            with shuffles_freed(spark):
                rows = keep(codec.encode_packed(form.dtype, docs, id_col, text_col))
            codec.close()
        for last in (False, True):
            counts = sorted((r[0], r[1]) for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(counted(F.col("n"), length))).collect())
            bases, total = {}, 0
            for p, n in counts:
                bases[p] = (total, n)
                total += n
            order = Permutation(total, key)
            shards = -(-total // per_shard)
            if not total:
                return spark.createDataFrame([], MANIFEST), path, order
            ranges = min(passes, shards)
            cuts = [shards * i // ranges for i in range(ranges + 1)]
            manifests = [f"{path}/manifest/{i}" for i in range(ranges)]
            try:
                for low, high, manifest in zip(cuts, cuts[1:], manifests):
                    writers = min(high - low, MAX_WRITERS)
                    parts = _scatter(rows, bases, order, low * per_shard, high * per_shard, per_shard, length, form)
                    parts = parts.repartitionById(writers, F.expr(f"cast(cast(shard - {low} as bigint) * {writers} div {high - low} as int)")).sortWithinPartitions("shard")
                    with shuffles_freed(spark):
                        _write(parts, path, total, per_shard, stride).write.mode("overwrite").parquet(manifest)
                break
            except Exception as e:
                drop_dir(spark, path)
                if last or SPLIT not in str(e):
                    raise
                rows = keep(rows)
    finally:
        for folder in kept:
            drop_dir(spark, folder)
    return spark.read.schema(MANIFEST).parquet(*manifests), path, order


def read_sequences(spark: SparkSession, manifest: DataFrame, path: str, length: int = LENGTH, from_slot: int = 0, codec: Codec | None = None) -> DataFrame:
    """(slot, shard, record, doc_id, sequence, n_ids, ids) from a slot on: each shard is read from there to its end, in
    blocks, from the place that its stride gives, by a task of its own (up to MAX_WRITERS). ids are the bytes of the ids without padding; codec as for materialise."""
    width = form_of(codec).width
    stride = HEAD_SIZE + length * width
    schema = "slot long, shard int, record long, doc_id long, sequence int, n_ids int, ids binary"

    def run(batches: Iterator[pa.RecordBatch]):
        store, folder = _filesystem(path)
        for b in batches:
            for m in b.to_pylist():
                skip = max(0, from_slot - m["first_slot"])
                with store.open_input_file(f"{folder}/{m['file']}") as f:
                    f.seek(skip * stride)
                    while skip < m["records"]:
                        n = min(4096, m["records"] - skip)
                        raw = f.read(n * stride)
                        heads = [struct.unpack_from(HEADER, raw, i * stride) for i in range(n)]
                        record = np.arange(skip, skip + n)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(record + m["first_slot"]), pa.array([m["shard"]] * n, pa.int32()), pa.array(record),
                            pa.array([None if h[0] == NULL_ID else h[0] for h in heads], pa.int64()), pa.array([h[1] for h in heads], pa.int32()), pa.array([h[2] for h in heads], pa.int32()),
                            pa.array([raw[i * stride + HEAD_SIZE : i * stride + HEAD_SIZE + h[2] * width] for i, h in enumerate(heads)], pa.binary()),
                        ], [x.split()[0] for x in schema.split(", ")])
                        skip += n

    wanted = manifest.filter(F.col("first_slot") + F.col("records") > from_slot).select("shard", "file", "first_slot", "records")
    first, n = wanted.agg(F.coalesce(F.min("shard"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(n, MAX_WRITERS))
    # An explicit number of tasks is one that adaptive execution doesn't lower, small as the manifest is.
    return wanted.repartitionById(tasks, F.expr(f"cast(cast(shard - {first} as bigint) * {tasks} div {max(n, 1)} as int)")).mapInArrow(run, schema)
