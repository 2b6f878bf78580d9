"""Five stages that make token ids of a corpus, each an operator of tempograph.llm over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import bpe, lines, mixing, neardup, quality
from tempograph.llm.common import stored
from tempograph.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No source is passed over more often than this; none less than once, so mixing loses no document.
MAX_REPEATS = 1.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, and those of hosts that fail. Null and empty texts fail; rows without source are
    judged by themselves; rows that repeat an id or a text are judged each; no rows give none."""
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in five documents stay in the last one only; n_chars follows the text. Null texts become empty ones;
    a null doc_id is below all others; rows that repeat an id keep or lose a line together. Columns besides those of
    documents stay, but for n_lines and n_dropped."""
    out = lines.dedup_lines(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id; rows that repeat this id stay with it,
    and rows without id. Texts without words are one class."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, as far as the repetition limit lets the mix go. A null
    source is one of its own; rows that repeat an id are repeated together; columns called weight, block or order_key go."""
    mixed = mixing.mix(docs, mixing.mix_plan(docs, max_repeats=MAX_REPEATS))
    return mixed.drop("weight", "block", "order_key")


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of tokens and the digests of its ids and of what they decode to. Null and empty texts have no
    tokens; rows that repeat a document have a row each, and are encoded once."""
    codec = bpe.Codec(spark, *vocabulary())
    return codec.encode_digests(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: Near duplicates, permutations and token ids aren't SQL's; tests run the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
