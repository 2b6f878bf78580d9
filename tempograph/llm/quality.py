"""Quality rules of documents and of their hosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, join_spread, stored, stored_seen

GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 10, 5, 20, 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A rule's name and what fails it. A document goes by the first two; all tell of its host.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
#: Plans of verdicts of at most so many hosts, which are counted, are broadcast.
BROADCAST_HOSTS = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once however often body names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, the first included. Windows are compared by 64-bit hashes; only where
    one recurs are they sorted, so that equal ones are neighbours."""

    def covered(ordered):
        twin = lambda x, k: (k > 0) & (F.get(ordered, k - 1)["g"] == x["g"]) | F.coalesce(F.get(ordered, k + 1)["g"] == x["g"], F.lit(False))
        at = F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"]))
        steps = lambda a: F.transform(a, lambda x, k: F.least(F.get(a, k + 1) - x, F.lit(window)))  # noqa: E731  the last has no next: a whole window
        return let(at, lambda a: F.aggregate(steps(a), F.lit(0), lambda total, x: total + x))

    def of_grams(grams):
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ordered, covered))

    def of_hashes(h):
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(window))))
        return F.when(F.size(h) > window, let(grams, of_grams)).otherwise(F.lit(0))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(text: Column, window: int = WINDOW) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, from array expressions on
    the row's own text: nothing is shuffled. Null and empty texts have no words and fail."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = lambda w: [F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w, window).cast("long").alias("n_repeat_words")]
    failed = lambda m: (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    doubles = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return let(let(words, lambda w: F.struct(*counts(w))), lambda m: F.struct(m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), doubles.alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), failed(m).alias("base_failed")))


def host_table(features: DataFrame, host_col: str = "host", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, <rule>_failed, <rule>_rate, host_rule, host_kept): each host's failures of the base
    rules together and of every rule, and their rates shrunk towards the mean of all hosts by beta priors, whose strengths
    are estimated from how hosts differ in that rule (moments of the beta-binomial). A host is kept unless one of its
    shrunken rates is above max_rate; host_rule names the worst then ("base" for both base rules together). Rows without
    host form none.
    """
    counts = {f"{name}_failed": F.count_if(F.expr(rule)) for name, rule in RULES.items()}
    hosts = features.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"), *(c.alias(n) for n, c in counts.items()))
    hosts, _ = stored(hosts, "hosts")
    rates = {"base": ("n_failed", "rate")} | {name: (f"{name}_failed", f"{name}_rate") for name in RULES}
    priors = beta_priors(hosts, [f for f, _ in rates.values()])
    out = hosts
    for failed, rate in rates.values():
        alpha, beta = priors[failed]
        out = out.withColumn(rate, (F.col(failed) + alpha) / (F.col("n_docs") + alpha + beta))
    worst = F.greatest(*(F.struct(F.col(rate).alias("rate"), F.lit(name).alias("rule")) for name, (_, rate) in rates.items()))
    return out.withColumn("host_rule", F.when(worst["rate"] > max_rate, worst["rule"])).withColumn("host_kept", worst["rate"] <= max_rate)


def beta_priors(hosts: DataFrame, failed: list[str]) -> dict[str, tuple[float, float]]:
    """alpha and beta of each count of failures, from one row of sums over (n_docs, failures). A weak prior where there is
    nothing to estimate."""
    sums = [x for c in failed for x in (F.sum(c).alias(f"f_{c}"), F.sum(F.col(c).cast("double") * F.col(c) / F.col("n_docs")).alias(f"p_{c}"))]
    s = hosts.agg(F.count("*").alias("h"), F.sum("n_docs").alias("n"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("sq"), *sums).first()
    return {c: _beta(s["h"], s["n"] or 0, s["sq"] or 0.0, s[f"f_{c}"] or 0, s[f"p_{c}"] or 0.0) for c in failed}


def _beta(h: int, n: int, square: float, f: int, per: float) -> tuple[float, float]:
    if not n:
        return 1.0, 1.0
    mean = (f + 0.5) / (n + 1)
    left = n - square / n - (h - 1)
    rho = ((per - f * f / n) / (mean * (1 - mean)) - (h - 1)) / left if left > 0 else 0.5
    rho = min(max(rho, 1e-4), 0.5)
    return mean * (1 / rho - 1), (1 - mean) * (1 / rho - 1)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, the measures, base_failed, kept, host, host_rate, host_rule): one row for each row of docs.

    kept is false where a base rule fails or the host isn't kept; documents without host are judged by the base rules
    alone. Each row is judged by itself, rows that repeat an id or a text too; null and empty texts fail; a very long text
    is measured whole, in its own row. Other columns are ignored. The measures are written once (no texts), and hosts, one
    row each, are joined to them: all by a broadcast if they are few, counted; else those with a HOT_KEYS-th of all rows.
    """
    features = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m")).select("doc_id", "host", "m.*")
    features, _ = stored(features, "quality")
    hosts, _, seen = stored_seen(host_table(features, max_rate=max_rate), "verdicts", n=F.count("*"), rows=F.sum("n_docs"))
    verdicts = hosts.select("host", "n_docs", F.col("rate").alias("host_rate"), "host_rule", "host_kept")
    if seen["n"] <= BROADCAST_HOSTS:
        joined = features.join(F.broadcast(verdicts), "host", "left")
    else:
        none = features.filter("host is null")
        joined = join_spread(features.filter("host is not null"), verdicts, "host", F.col("n_docs"), seen["rows"]).unionByName(none, allowMissingColumns=True)
    return joined.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "host", "host_rate", "host_rule")


def filter_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that the rules and their host's verdict keep, with their columns as they are, whatever their names.
    Texts are measured once: rows that pass are written with a mark of their host, and what hosts need of all rows beside
    them. Of the rejected hosts, those with a HOT_KEYS-th of all rows are broadcast, and the others too if they are few."""
    host = F.col(host_col).cast("string")
    marked, _ = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), host.alias("host"), measures(F.col(text_col)).alias("m")).select(F.when(~F.col("m.base_failed"), F.col("row")).alias("row"), "host", "m.*"), "measured")
    hosts, _, seen = stored_seen(host_table(marked.drop("row"), max_rate=max_rate).filter(~F.col("host_kept")).select("host", "n_docs"), "rejected", n=F.count("*"))
    kept = marked.filter("not base_failed").select("row", "host")
    if seen["n"]:
        total = marked.count()
        few = seen["n"] <= BROADCAST_HOSTS
        hot, cold = (hosts, None) if few else (hosts.filter(F.col("n_docs") * HOT_KEYS >= total), hosts.filter(F.col("n_docs") * HOT_KEYS < total))
        kept = kept.join(F.broadcast(hot.select("host")), "host", "left_anti")
        if cold is not None:
            kept = kept.join(cold.select("host").hint("merge"), "host", "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
