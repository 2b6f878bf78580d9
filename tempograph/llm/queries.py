"""Queries of the ten operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, media, mixing, neardup, pii, quality, sequences, sharding, urls
from .common import stored, text_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """The file of ranks and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page with one figure, whose reference is resolved to what its stored bytes hold: the media are
    written to the shared folder, and features are computed from what is read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").cast("binary").alias("data"))
    written, _ = stored(media.media_table(docs), "media", compression="zstd")
    stored_media = media.media_features(written)
    fill = (media.UNIT - F.octet_length("data") % media.UNIT) % media.UNIT + F.when(F.octet_length("data") == 0, media.UNIT).otherwise(0)
    digest = F.sha2(F.concat("data", F.unhex(F.repeat(F.lit("FF"), fill.cast("int")))), 256)
    pages = docs.select("doc_id", media.document_page(digest, F.col("doc_id")).alias("html"))
    columns = [c.split()[0] for c in media.FEATURES.split(", ")][1:]
    items = media.resolved(media.sequences(pages, "doc_id", "html"), stored_media, *columns)
    return items.filter("kind = 'media'").select(F.col("id").alias("doc_id"), *columns, "position", "caption")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op4_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence of the corpus's token ids was written, read back from the shards."""
    codec = bpe.Codec(spark, *vocabulary())
    manifest, path, _ = sequences.materialise(table(spark, sf_dir, "documents"), codec=codec)
    return sequences.read_sequences(spark, manifest, path, codec=codec).select("slot", "shard", "record", "doc_id", "sequence", "n_ids", F.crc32("ids").alias("ids_crc32"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.MEASURES, "base_failed", "kept", F.col("host").alias("source"), F.round("host_rate", 6).alias("host_rate"), "host_rule")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes' worth of tokens at most over any source. Tokens are counted by runs of letters, digits and other signs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.pre_tokens().alias("n_tokens"))
    plan = mixing.mix_plan(sized, tokens=F.col("n_tokens"))
    return mixing.mix(sized, plan).select("doc_id", "source", "n_tokens", "weight", "block", "order_key")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(spark, *vocabulary())
    out = codec.encode_digests(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return out.select("doc_id", size.alias("size"), F.crc32(text_of("text").cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_lines, op3_urls, op4_sequences, op5_neardup, op6_quality, op7_mixing, op8_pii, op9_bpe, op10_sharding)}


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
with l as (
  select doc_id, i, line, {_LOWER.format(f"trim(line, {_BLANKS})")} as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), often as (
  select k, max(doc_id) as keeper from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), j as (
  select l.*, coalesce(l.doc_id <> o.keeper, false) as dropped from l left join often o on l.k = o.k
)
select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from j group by doc_id
"""

#: The pages of the test tables have no canonical link or refresh, so no verdict spreads.
OP3_SQL = """
with p as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), r(what, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), f as (
  select page_id, max_by(r.h || r.p, length(r.h || r.p)) as rule, max_by(what, length(r.h || r.p)) as what
  from h join r on (h.host = r.h or ends_with(h.host, '.' || r.h)) and starts_with(h.path, r.p) group by page_id
)
select h.page_id, host, path, rule, coalesce(what, 'allow') as verdict, cast(1 as bigint) as n_aliases from h left join f using (page_id)
"""

OP6_MEASURES = """
with d as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents
), g as (
  select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
), t as (select doc_id, unnest([i, i+1, i+2, i+3, i+4]) as pos from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1
), c as (select doc_id, count(distinct pos) as n from t group by doc_id
), m as (
  select d.doc_id, source, text, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
  from d left join c using (doc_id)
), b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m
), hosts as (select source, count(*) as n, cast(sum(base_failed::int) as double) as base, {sums} from b where source is not null group by source
), u as ({unpivot}
), s as (select rule, count(*) as h, sum(n) as n, sum(f) as f, sum(f * f / n) as per, sum(n * n) as sq from u group by rule
), e as (select *, (f + 0.5) / (n + 1) as mean, n - sq / n - (h - 1) as rest from s
), p as (select rule, mean, least(greatest(case when rest > 0 then ((per - f * f / n) / (mean * (1 - mean)) - (h - 1)) / rest else 0.5 end, 1e-4), 0.5) as rho from e
), r as (select source, rule, (f + mean * (1 / rho - 1)) / (n + 1 / rho - 1) as rate from u join p using (rule)
), v as (select source, max(rate) filter (where rule = 'base') as rate, max(rate) as worst, max_by(rule, (rate, rule)) as worst_rule from r group by source)
""".format(sums=", ".join(f"cast(sum(({rule})::int) as double) as {name}" for name, rule in quality.RULES.items()), unpivot=" union all ".join(f"select source, n, '{name}' as rule, {name} as f from hosts" for name in ("base", *quality.RULES)))
OP6_SQL = OP6_MEASURES + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(worst <= 0.5, true) as kept, source, round(rate, 6) as host_rate, case when worst > 0.5 then worst_rule end as host_rule
from b left join v using (source)
"""


def oracle_sql() -> dict[str, str]:
    """The other operators hash, permute, estimate or tokenise in ways that SQL hasn't; tests hold them against brute force."""
    return {"op2_lines": OP2_SQL, "op3_urls": OP3_SQL, "op6_quality": OP6_SQL}
