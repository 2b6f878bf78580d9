"""Mixing sources to target weights by a temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_dir, join_spread, stored, text_of

SEED, MAX_REPEATS = 71, 2.0
#: A plan of at most so many sources, which are counted, is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Exponents that one pass over the sources' totals tries; each pass narrows the interval by so much.
TRIED = 64
#: Orders are 60-bit hashes; their first 12 bits are the bucket in which the cut of a block is searched.
HASH_BITS, BUCKET_BITS = 60, 12
PRE_TOKENS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def pre_tokens(text_col: str = "text") -> Column:
    """About how many tokens a text has: its runs of letters, of digits and of other signs."""
    return F.regexp_count(text_of(text_col), F.lit(PRE_TOKENS)).cast("long")


def _powers(totals: DataFrame, top: float, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent x, over the sources' token totals n: the sum of r = (n / top)^x, and the sum of r * ln r. One job
    whose result is as many rows as exponents."""
    tried = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(exponents))))
    rows = totals.filter("n > 0").select(F.log(F.col("n") / top).alias("l"), tried.alias("e")).select("e.i", (F.col("l") * F.col("e.x")).alias("p"))
    got = {r[0]: (r[1], r[2]) for r in rows.groupBy("i").agg(F.sum(F.exp("p")), F.sum(F.exp("p") * F.col("p"))).collect()}
    return [got.get(i, (1.0, 0.0)) for i in range(len(exponents))]


def entropy_of(power: tuple[float, float]) -> float:
    """Of the weights r / sum(r)."""
    return math.log(power[0]) - power[1] / power[0]


def spread_of(power: tuple[float, float], x: float, least: float, top: float, total: float, budget_share: float | None) -> float:
    """The most passes over any source. As x is at most 1, that is the source of least tokens, and the one of most has the
    fewest. budget_share: tokens to realise, as a multiple of those there are; None: so many that no source has less than
    one pass."""
    ratio = lambda n: (n / top) ** x / power[0] * total / n
    return ratio(least) * (budget_share if budget_share is not None else 1 / ratio(top))


def find_exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_share: float | None = None) -> float:
    """The exponent from 0 (all sources alike) to 1 (as they are) that meets the entropy, or else the least one that keeps
    within the repeats. Both fall as it rises, so it is bisected, TRIED parts at a time; what can't be met gives the nearer
    end. totals: (key, n), a row for each source; they stay distributed, however many."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    top, least, total = totals.filter("n > 0").agg(F.max("n"), F.min("n"), F.sum("n")).first()
    if top is None:
        return 0.0

    def above(power, x):
        return entropy_of(power) > target_entropy if max_repeats is None else spread_of(power, x, least, top, total, budget_share) > max_repeats

    low, high = 0.0, 1.0
    if not above(_powers(totals, top, [0.0])[0], 0.0):
        return low
    while high - low > 1e-15 and high - low > 1e-12 * high:
        tried = [low + (high - low) * (i + 1) / TRIED for i in range(TRIED - 1)]
        tried = [x for x in tried if low < x < high]
        if not tried:
            break
        is_above = [above(p, x) for p, x in zip(_powers(totals, top, tried), tried, strict=True)]
        after = next((i for i, a in enumerate(is_above) if not a), len(tried))
        low, high = (tried[after - 1] if after else low), (tried[after] if after < len(tried) else high)
    return high


def _key(source: str) -> Column:
    """Tells a source that is null from one that is empty."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null"))


def _order(id_col: str, block: Column, seed: int) -> Column:
    """A document's place in the permutation of a block."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block.cast("long"), F.col(id_col)), 64 - HASH_BITS)


def mix_plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """(key, weight, repeats, blocks, cut, n_rows): what each source is realised with. blocks whole passes, then the
    documents whose order in the permutation of the next block is at most cut.

    tokens: each row's number of tokens, UTF-8 bytes if not given; pre_tokens counts nearer. budget: tokens to realise; by
    default so many that no source has less than one pass. Each source's total is one row, and neither these nor the plan
    leave the cluster, so there may be any number of sources. The cut is where a source's budget ends: tokens are summed by
    (source, bucket of the order), at most 4096 rows a source, and only the bucket in which the budget ends is summed
    document by document. So a source with a third of all rows is never gathered. Documents with one id are in or out
    together. Null texts have no tokens; a source without tokens is passed over once; null is a source of its own.
    """
    size = F.octet_length(text_of(text_col)) if tokens is None else tokens
    rows = docs.select(_key(source_col).alias("key"), F.coalesce(size.cast("long"), F.lit(0)).cast("long").alias("n"), F.col(id_col).alias("id"))
    rows, rows_path = stored(rows, "mixtokens")
    totals, _ = stored(rows.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows")), "mixtotals")
    top, total = totals.agg(F.max("n"), F.sum("n")).first()
    top, total = float(top or 0) or 1.0, float(total or 0)
    budget_share = None if budget is None else budget / max(total, 1)
    x = find_exponent(totals, target_entropy, max_repeats, budget_share)
    power = _powers(totals, top, [x])[0][0]
    if budget_share is None:
        budget_share = power * top / max(total, 1)  # one pass over the source of most tokens
    n, has = F.col("n").cast("double"), F.col("n") > 0
    weight = F.when(has, F.pow(n / top, F.lit(x)) / power).otherwise(0.0)
    repeats = F.when(has, weight * budget_share * total / n).otherwise(1.0)
    repeats = F.when(F.abs(repeats - F.rint(repeats)) < 1e-6, F.rint(repeats)).otherwise(repeats)
    plan = totals.withColumn("weight", weight).withColumn("repeats", repeats).withColumn("blocks", F.floor("repeats").cast("long"))
    plan, _ = stored(plan.withColumn("rest", F.floor((F.col("repeats") - F.col("blocks")) * n).cast("long")), "mixplan")
    docs_n = totals.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    part = _with_plan(rows, plan.filter("rest > 0").select("key", "rest", "blocks", "n_rows"), docs_n).select("key", "n", "rest", _order("id", F.col("blocks"), seed).alias("order")).withColumn("bucket", F.shiftright("order", HASH_BITS - BUCKET_BITS))
    up_to = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = part.groupBy("key", "bucket", "rest").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(up_to)).filter("upto > rest")
    ends = ends.groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("e")).select("key", "e.*")
    inner = part.join(ends, ["key", "bucket"]).groupBy("key", "bucket", "before", "rest", "order").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("key").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("upto", F.col("before") + F.sum("n").over(along)).groupBy("key", "bucket").agg(F.max(F.when(F.expr("upto <= rest"), F.col("order"))).alias("last"))
    cuts = inner.select("key", F.coalesce("last", F.shiftleft("bucket", HASH_BITS - BUCKET_BITS) - 1).alias("cut"))
    cuts, _ = stored(cuts, "mixcuts")
    drop_dir(docs.sparkSession, rows_path)
    return plan.join(cuts, "key", "left").select("key", "weight", "repeats", "blocks", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"), "n_rows")


def _with_plan(rows: DataFrame, plan: DataFrame, total: int, key: str = "key", n: str = "n_rows") -> DataFrame:
    """rows with their source's columns of the plan. A plan of few sources, counted, is broadcast, and rows stay where they
    are; of a larger one, the sources that have a HOT_KEYS-th of all rows (so many at most) are, and the others' rows are
    shuffled."""
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), key)
    return join_spread(rows, plan, key, F.col(n), total)


def mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """docs with each row as often as its source's blocks have it, and weight, block and order_key; columns of these names
    are replaced, all others stay. Sorted by order_key, the rows are the training order: each block of a source is a
    permutation of it, blocks follow each other, and every source is spread over the whole at its weight. Rows of null ids
    or sources count like others; rows that repeat an id are in or out together. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("weight", "block", "order_key")]
    rows = docs.select(*kept).withColumn("__key", _key(source_col))
    own = plan.select(F.col("key").alias("__key"), F.col("weight").alias("__weight"), F.col("repeats").alias("__repeats"), F.col("blocks").alias("__blocks"), F.col("cut").alias("__cut"), F.col("n_rows").alias("__n_rows"))
    total = plan.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    joined = _with_plan(rows, own, total, "__key", "__n_rows")
    copies = F.col("__blocks") + F.when(_order(id_col, F.col("__blocks"), seed) <= F.col("__cut"), 1).otherwise(0)
    joined = joined.withColumn("__copies", copies.cast("int")).filter("__copies > 0").withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    place = _order(id_col, F.col("__block"), seed).cast("double") / float(1 << HASH_BITS)
    order = (F.col("__block") + place) / F.greatest(F.col("__repeats"), F.lit(1e-12))
    return joined.select(*(f"`{c}`" for c in kept), F.col("__weight").alias("weight"), F.col("__block").alias("block"), order.alias("order_key"))
