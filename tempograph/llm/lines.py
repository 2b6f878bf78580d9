"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

import itertools
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_BYTES, drop_dir, join_spread, shared_dir, stored, text_of, tidy

MIN_CHARS, MIN_DOCS, FANOUT, BATCHES = 40, 5, 3, 4
RUN = "key binary, n_docs long, keeper long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of a line stripped of blanks with A-Z lower-cased; None for keys of fewer code points."""
    key = line.strip(BLANK_BYTES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id): the distinct keys of each row's lines."""

    def run(batches):
        for b in batches:
            keys, ids = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = {k for line in text.as_py().encode().split(b"\n") if (k := line_key(line, min_chars))}
                keys += own
                ids += [key] * len(own)
                if len(keys) > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])
                    keys, ids = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])
            keys, ids = [], []
            tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "key binary, doc_id long")


class LineRuns:
    """Sorted runs of line keys in levels: `fanout` runs of one level are merged into one of the next.

    A run is a Parquet table of rows (key, n_docs, keeper), keeper being the largest doc_id that holds the key, dealt by
    key into a fixed number of buckets, one sorted file each. Runs are disjoint: a batch is merge-anti-joined with all of
    them, and only keys that none of them has make its own run; what it knows of keys that one has goes into a run of
    updates, which is folded in when runs are compacted. As all runs are dealt alike, neither the anti-join nor the
    compaction moves a row of an old run. Runs are immutable files in the shared folder, so a lost task or a failed batch
    leaves the others as they were; the session's catalog knows them by name. saved() tells what a later session needs to
    go on with them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or shared_dir(spark, "lineruns")
        self.levels: list[list[str]] = []
        self.updates: list[str] = []

    def saved(self) -> dict:
        return {"path": self.path, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels, "updates": self.updates}

    @classmethod
    def resumed(cls, spark: SparkSession, saved: dict) -> LineRuns:
        """The runs of an earlier session, by the files that it left."""
        runs = cls(spark, saved["path"], saved["fanout"], saved["buckets"])
        runs.levels, runs.updates = [list(x) for x in saved["levels"]], list(saved["updates"])
        for name in [*itertools.chain(*runs.levels), *runs.updates]:
            if not spark.catalog.tableExists(name):
                spark.sql(f"create table {name} ({RUN.replace(' long', ' bigint')}) using parquet clustered by (key) sorted by (key) into {runs.buckets} buckets location '{runs.path}/{name}'")
        return runs

    def _write(self, rows: DataFrame) -> str | None:
        """A run of rows that have one row for each key; None if there are none."""
        name, watch = f"linerun_{uuid.uuid4().hex}", Observation()
        rows.observe(watch, F.count("*").alias("n")).write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        if watch.get["n"]:
            return name
        self._drop(name)
        return None

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        drop_dir(self.spark, f"{self.path}/{name}")

    def _read(self, names: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], RUN)
        for name in names:
            out = out.unionAll(self.spark.table(name))
        return out

    def _folded(self, run: DataFrame, updates: list[str]) -> DataFrame:
        for name in updates:
            u = self.spark.table(name).select("key", F.col("n_docs").alias("__n"), F.col("keeper").alias("__keeper"))
            run = run.join(u.hint("merge"), "key", "left").select("key", (F.col("n_docs") + F.coalesce("__n", F.lit(0))).alias("n_docs"), F.greatest("keeper", "__keeper").alias("keeper"))
        return run

    def runs(self) -> list[str]:
        return list(itertools.chain(*self.levels))

    def known(self, keys: DataFrame, fresh: bool) -> DataFrame:
        """The rows of a table with a column key whose key is in a run, or, if fresh, in none: a merge join for each run,
        which moves no row of the run."""
        if fresh:
            for name in self.runs():
                keys = keys.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
            return keys
        found = keys.limit(0)
        for name in self.runs():
            found = found.unionAll(keys.join(self.spark.table(name).select("key").hint("merge"), "key", "left_semi"))
        return found

    def add(self, keys: DataFrame) -> None:
        """Takes in a batch of (key, doc_id): its fresh keys as a run, what it tells of known ones as updates; then compacts
        full levels. Counts are combined before the shuffle, so a line that all documents share is one row from each task."""
        batch = keys.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if not self.runs():
            new, more = self._write(batch), None
        else:
            batch, path = stored(batch, "linebatch")
            new, more = self._write(self.known(batch, True)), self._write(self.known(batch, False))
            drop_dir(self.spark, path)
        if more:
            self.updates.append(more)
        for level in itertools.count():
            if level == len(self.levels):
                self.levels.append([])
            if new:
                self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            self._fold_updates(old)
            new = self._write(self._read(old))
            for name in old:
                self._drop(name)

    def _fold_updates(self, old: list[str]) -> None:
        """Folds the updates into the runs that are about to be merged. Updates of keys of other runs stay."""
        if not self.updates:
            return
        for i, name in enumerate(old):
            folded = self._write(self._folded(self.spark.table(name), self.updates))
            old[i] = folded
            left = [self._write(self.spark.table(u).join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")) for u in self.updates]
            for u in [*self.updates, name]:
                self._drop(u)
            self.updates = [u for u in left if u]

    def merged(self) -> DataFrame:
        """(key, n_docs, keeper) over all runs. Runs are disjoint, so nothing is aggregated."""
        out = self.spark.createDataFrame([], RUN)
        for name in self.runs():
            out = out.unionAll(self._folded(self.spark.table(name), self.updates))
        return out

    def dropped(self, keys: DataFrame, total: int, min_docs: int = MIN_DOCS) -> DataFrame:
        """The rows, of `total`, whose key is in at least min_docs documents and that aren't its keeper's. A key that very
        many rows share is joined by a broadcast, which has a size bound; see join_spread."""
        often, path = stored(self.merged().filter(F.col("n_docs") >= min_docs), "lineoften")
        self.often_path = path
        return join_spread(keys.select("key", "doc_id"), often, "key", F.col("n_docs"), total).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("key", "doc_id")

    def close(self) -> None:
        """Forgets and deletes all runs."""
        for name in [*self.runs(), *self.updates]:
            self._drop(name)
        self.levels, self.updates = [], []
        drop_dir(self.spark, self.path)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with their texts rid of repeated lines, and n_lines and n_dropped.

    The keys of all lines are written once to the shared folder, dealt into batches by doc_id; each batch meets the runs
    and adds its own, and in the end all keys meet the runs. A key of at least min_chars code points in at least min_docs
    documents loses all its lines but those of its largest doc_id. Each row counts as a document; rows that repeat a doc_id
    keep or lose their lines together. A null doc_id is below all others: its lines go if a key has another holder, and
    stay if it has none. Null texts are one empty line and come back as empty texts. All other columns stay; columns
    called n_lines and n_dropped are replaced.
    """
    spark = docs.sparkSession
    dealt = line_keys(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    path = shared_dir(spark, "linekeys")
    watch = Observation()
    dealt.observe(watch, F.count("*").alias("n")).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("key binary, doc_id long, batch int").parquet(path)
    runs = LineRuns(spark, fanout=fanout)
    for i in range(batches):
        runs.add(keys.filter(F.col("batch") == i))
    lost = runs.dropped(keys, watch.get["n"], min_docs).groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    lost, _ = stored(lost, "linedrops")
    drop_dir(spark, path)
    drop_dir(spark, runs.often_path)
    runs.close()

    def run(batches_):
        for b in batches_:
            texts, total, gone = [], [], []
            out, size, at = b.drop_columns(["__lost"]), 0, 0
            text_at = out.schema.names.index(text_col)

            def part(end):
                piece = out.slice(at, end - at)
                columns = [pa.array(texts, pa.string()) if i == text_at else piece.column(i) for i in range(piece.num_columns)]
                return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*out.schema.names, "n_lines", "n_dropped"])

            for i, (text, drops) in enumerate(zip(b.column(text_at), b.column("__lost"), strict=True)):
                lines = (text.as_py() or "").encode().split(b"\n")
                bad = set(drops.as_py() or ())
                kept = [x for x in lines if line_key(x, min_chars) not in bad] if bad else lines
                texts.append(b"\n".join(kept).decode())
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
                size += len(texts[-1])
                if size > 1 << 23:
                    yield part(i + 1)
                    texts, total, gone, size, at = [], [], [], 0, i + 1
            yield part(b.num_rows)
            tidy()

    kept = docs.drop("n_lines", "n_dropped").withColumn(text_col, text_of(text_col))
    # A merge join at any size: the list grows with the corpus, and only both sides sorted can spill.
    joined = kept.join(lost.select(F.col("doc_id").alias("__id"), F.col("lost").alias("__lost")).hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left").drop("__id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return joined.mapInArrow(run, f"{schema}, n_lines long, n_dropped long")


