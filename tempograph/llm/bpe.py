"""Byte-level BPE encoding and decoding over overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_dir, stored, text_of, tidy

CHUNK, OVERLAP = 32_768, 1_024
#: A boundary nearer than this to a cut may change with what follows the cut: contractions have three characters.
MARGIN = 4
DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
PIECES = "row_id long, id long, piece long, ids array<int>"
PACKED = "id long, n long, ids binary"


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of text end. The pattern looks right only, so from any boundary on they are settled."""
    return [m.end() for m in _pattern(pattern).finditer(text)]


def _packer(dtype: str):
    """From batches of PIECES, a row's pieces in order, to batches of PACKED."""
    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, key, parts, out = None, None, [], []

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([len(x[1]) // size for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["id", "n", "ids"])

        for b in batches:
            ids, at = b.column(3), 0
            raw = ids.flatten().to_numpy().astype(dtype).tobytes()
            for r, k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ids.value_lengths().to_pylist(), strict=True):
                if r != row:
                    if row is not None:
                        out.append((key, b"".join(parts)))
                    row, key, parts = r, k, []
                parts.append(raw[at : at + n * size])
                at += n * size
            if out:
                yield flushed()
                out = []
        if row is not None:
            out.append((key, b"".join(parts)))
            yield flushed()

    return run


class Codec:
    """Encodes and decodes with a file of ranks. The file's bytes go to the executors in a broadcast: a vocabulary
    has a fixed size, below a few MB, whatever the corpus."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 2 * MARGIN <= overlap <= chunk:
            raise ValueError(f"overlap must be from {2 * MARGIN} to chunk")
        with open(ranks_path, "rb") as f:
            self.ranks = spark.sparkContext.broadcast(f.read())
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap
        self.spark, self.folders = spark, []

    @property
    def size(self) -> int:
        """One more than the largest id."""
        return 1 + max(int(x.split()[1]) for x in self.ranks.value.splitlines() if x)

    def _encoder(self):
        """From batches of row_id, id, piece, text to batches of PIECES."""
        ranks, pattern = self.ranks, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = _encoding(ranks.value, pattern)
            last, ids = None, None  # rows that repeat a document follow each other
            for b in batches:
                at = 0
                while at < b.num_rows:
                    got, size, start = [], 0, at
                    while at < b.num_rows and size < 1 << 19:
                        text = b.column(3)[at].as_py()
                        if text != last:
                            # There are no special tokens to look for, so this is the same and costs less.
                            last, ids = text, np.array(array("i", enc.encode_ordinary(text)))
                        got.append(ids)
                        size += len(ids)
                        at += 1
                    ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(ends, np.concatenate(got).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*(b.column(i).slice(start, at - start) for i in range(3)), lists], ["row_id", "id", "piece", "ids"])
                tidy()

        return run

    def _chunks(self, long: DataFrame) -> DataFrame:
        """Each long text as chunks that reach into the next one, and the pre-token boundaries of both overlaps."""
        chunk, overlap, pattern = self.chunk, self.overlap, self.pattern

        def cut(batches):
            for b in batches:
                for row, key, text in zip(*(b.column(i) for i in range(3)), strict=True):
                    t = text.as_py()
                    for k, s in enumerate(range(0, len(t), chunk)):
                        yield pa.RecordBatch.from_pydict({"row_id": [row.as_py()], "id": pa.array([key.as_py()], pa.int64()), "piece": [k], "start": [s], "total": [len(t)], "body": [t[s : s + chunk + overlap]]})

        def mark(batches):
            for b in batches:
                heads, tails = [], []
                for s, n, body in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                    safe = len(body) if s + len(body) == n else len(body) - MARGIN
                    ends = [e for e in boundaries(body, pattern) if e <= safe and not body[e - 1].isspace()]
                    heads.append([s + e for e in ends if e <= overlap])
                    tails.append([s + e for e in ends if e >= chunk])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*b.schema.names, "heads", "tails"])

        schema = "row_id long, id long, piece long, start long, total long, body string"
        return long.mapInArrow(cut, schema).repartition("row_id", "piece").mapInArrow(mark, f"{schema}, heads array<long>, tails array<long>")

    def _pieces(self, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        """(row_id, id, piece, text) of the texts of one piece, and of the pieces of longer ones."""
        rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
        size = F.length("text")
        short = rows.filter(size <= self.chunk).select("row_id", "id", F.lit(0).cast("long").alias("piece"), "text")
        marked, folder = stored(self._chunks(rows.filter(size > self.chunk)), "chunks")
        self.folders.append(folder)
        w, whole = Window.partitionBy("row_id").orderBy("piece"), Window.partitionBy("row_id")
        first = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(w))))
        seams = marked.select("row_id", "piece", "start", "total", first.alias("at")).withColumn("until", F.coalesce(F.lead("at").over(w), F.col("total")))
        lost = F.min(F.when(F.col("at").isNull(), F.col("piece"))).over(whole) - 1  # the last piece whose end isn't settled
        seams = seams.withColumn("lost", lost).withColumn("rest", F.coalesce(F.col("piece") >= F.col("lost"), F.lit(False)))
        start = F.when(F.col("rest") & (F.col("piece") > F.col("lost")), F.col("start")).otherwise(F.col("at"))
        end = F.when(F.col("rest"), F.least(F.col("start") + self.chunk, F.col("total"))).otherwise(F.col("until"))
        seams = seams.select("row_id", "piece", "lost", "rest", (start - F.col("start") + 1).cast("int").alias("from"), (end - start).cast("int").alias("n"))
        cut = marked.select("row_id", "id", "piece", "body").join(seams.hint("merge"), ["row_id", "piece"]).withColumn("text", F.expr("substring(body, `from`, n)"))
        pieces = cut.filter("not rest").select("row_id", "id", "piece", "text")
        tails = cut.filter("rest").groupBy("row_id", "id", F.col("lost").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))
        return short, pieces.unionByName(tails.select("row_id", "id", "piece", F.array_join(F.col("parts.text"), "").alias("text")))

    def close(self) -> None:
        """Deletes the chunks that encoding wrote. Call it when what was encoded has been written."""
        for folder in self.folders:
            drop_dir(self.spark, folder)
        self.folders = []

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(row_id, id, piece, ids): the token ids of every row's text; a row's pieces follow each other in one partition.

        Texts of at most `chunk` characters are one piece. Longer ones are cut into overlapping chunks, which are
        pre-tokenised apart; two neighbours are stitched at the first boundary that both have in their overlap, since from
        there on their pre-tokens agree, and that follows no blank, since the pattern takes blanks at an end otherwise than
        blanks before a word. The pieces between stitches are encoded apart. Where an overlap has no common boundary (in a
        run of letters longer than it, say), the text from the stitch before it on is one piece. Chunks are pre-tokenised
        once and kept in the shared folder. No text is cut short. Null and empty texts give one
        piece without ids. row_id tells rows of equal or null ids apart; docs must be a table that reads alike each time.
        Columns of other names are ignored.
        """
        short, long = self._pieces(docs, id_col, text_col)
        return short.mapInArrow(self._encoder(), PIECES).unionByName(self._in_order(long))

    def _in_order(self, pieces: DataFrame) -> DataFrame:
        return pieces.mapInArrow(self._encoder(), PIECES).repartition("row_id").sortWithinPartitions("row_id", "piece")

    def encode_digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """digests(encode(docs)), texts of one piece being encoded and hashed in one worker, so that their ids don't leave
        it."""
        short, long = self._pieces(docs, id_col, text_col)
        encode, digest = self._encoder(), self._digester()
        return short.mapInArrow(lambda batches: digest(encode(batches)), DIGESTS).unionByName(self.digests(self._in_order(long)))

    def encode_packed(self, dtype: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n, ids): how many ids each row's text has, and they as one binary of that dtype."""
        short, long = self._pieces(docs, id_col, text_col)
        encode, pack = self._encoder(), _packer(dtype)
        return short.mapInArrow(lambda batches: pack(encode(batches)), PACKED).unionByName(self._in_order(long).mapInArrow(pack, PACKED))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(row_id, id, piece, bytes): the bytes of the tokens of each piece, as they stand; pieces may split a character."""
        ranks, pattern = self.ranks, self.pattern

        def run(batches):
            enc = _encoding(ranks.value, pattern)
            for b in batches:
                out = [enc.decode_bytes(x) for x in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(out, pa.binary())], ["row_id", "id", "piece", "bytes"])

        return encoded.mapInArrow(run, "row_id long, id long, piece long, bytes binary")

    def digests(self, encoded: DataFrame) -> DataFrame:
        """(id, n_tokens, ids_sha256, decoded_sha256) of each row, hashed piece by piece in order."""
        return encoded.mapInArrow(self._digester(), DIGESTS)

    def _digester(self):
        ranks, pattern = self.ranks, self.pattern

        def run(batches):
            enc = _encoding(ranks.value, pattern)
            names = [str(i) for i in range(enc.n_vocab)]
            row, state, out = None, None, []

            def flushed():
                return pa.RecordBatch.from_pydict({"id": pa.array([x[0] for x in out], pa.int64()), "n_tokens": pa.array([x[1] for x in out], pa.int64()), "ids_sha256": [x[2] for x in out], "decoded_sha256": [x[3] for x in out]})

            def close():
                out.append((state[0], state[1], state[2].hexdigest(), state[3].hexdigest()))

            for b in batches:
                for r, key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                    if r != row:
                        if row is not None:
                            close()
                        row, state = r, [key, 0, hashlib.sha256(), hashlib.sha256()]
                    ids = ids.values.to_numpy().tolist() if len(ids) else []
                    if ids:
                        state[2].update((" " * (state[1] > 0) + " ".join(map(names.__getitem__, ids))).encode())
                        state[3].update(enc.decode_bytes(ids))
                        state[1] += len(ids)
                if out:
                    yield flushed()
                    out = []
            if row is not None:
                close()
                yield flushed()

        return run
