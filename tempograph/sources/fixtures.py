"""Graphs from the test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (tables that it reads, SQL).
GRAPHS = {
    "event_nodes": (("events",), """
        select concat('e', event_id) as id, event_type as type, event_id as num, 1 - least(value / 500, 1) as health_score, cast(case when event_type = 'error' then 1 else 0 end as double) as failure_prob,
          value as predicted_latency_ms, cast(0 as double) as resource_strain, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) as valid_to, 1 as version from events"""),
    "event_edges": (("events",), """
        select event_id as id, from_node_id, concat('e', event_id) as to_node_id, 'FeedsInto' as type, weight, cast(1 as double) as confidence, ts as valid_from, valid_to, event_id as seq from (
          select event_id, ts, concat('e', lag(event_id) over (partition by user_id order by ts, event_id)) as from_node_id, 1 - least(lag(value) over (partition by user_id order by ts, event_id) / 500, 1) as weight,
            lead(ts) over (partition by user_id order by ts, event_id) as valid_to, lag(event_id) over (partition by user_id order by ts, event_id) as prev from events) x where prev is not null"""),
    "user_nodes": (("events",), "select concat('u', user_id) as id, 'User' as type, avg(1 - least(value / 500, 1)) as health_score from events group by user_id"),
    "handoff": (("events",), """
        select concat('u', a) as from_node_id, concat('u', b) as to_node_id, 'FeedsInto' as type, least(n / cast(4 as double), 1) as weight, cast(1 as double) as confidence, a * 1000000 + b as seq from (
          select a, b, count(*) as n from (select lag(user_id) over (partition by date_trunc('hour', ts) order by ts, event_id) as a, user_id as b from events) x where a is not null and a <> b group by a, b) y"""),
    "handoff_groups": (("events",), """
        select distinct concat('u', a) as from_node_id, concat('u', b) as to_node_id, 'FeedsInto' as type, cast(1 as double) as weight, cast(1 as double) as confidence, a * 1000000 + b as seq from (
          select lag(u) over (partition by g order by day) as a, u as b from (select floor(user_id / 30) as g, date_trunc('day', ts) as day, max_by(user_id, (value, event_id)) as u from events group by 1, 2) w) x where a is not null and a <> b"""),
    "user_times": (("events",), "select concat('u', user_id) as id, 'User' as type, min(ts) as valid_from from events group by user_id"),
    "dated_handoff": (("events",), """
        select concat('u', a) as from_node_id, concat('u', b) as to_node_id, 'FeedsInto' as type, min(day) as valid_from, max(day) + interval 5 day as valid_to, a * 1000000 + b as seq from (
          select lag(u) over (partition by g order by day) as a, u as b, day from (select floor(user_id / 30) as g, date_trunc('day', ts) as day, max_by(user_id, (value, event_id)) as u from events group by 1, 2) w) x where a is not null and a <> b group by a, b"""),
    "commerce_nodes": (("region", "nation", "customer", "supplier", "part", "orders"), """
        select concat('r', r_regionkey) as id, 'Region' as type, cast(1 as double) as health_score from region union all select concat('n', n_nationkey), 'Nation', 1 from nation union all
        select concat('c', c_custkey), 'Customer', case when c_acctbal < 0 then 0.2 else 0.9 end from customer union all select concat('s', s_suppkey), 'Supplier', case when s_acctbal < 0 then 0.2 else 0.9 end from supplier union all
        select concat('p', p_partkey), 'Part', 1 from part union all select concat('o', o_orderkey), 'Order', 1 from orders"""),
    "commerce_edges": (("nation", "customer", "supplier", "orders", "lineitem"), """
        select concat('n', n_nationkey) as from_node_id, concat('r', n_regionkey) as to_node_id, 'DerivedFrom' as type, cast(1 as double) as weight, cast(1 as double) as confidence, cast(0 as bigint) as seq from nation union all
        select concat('c', c_custkey), concat('n', c_nationkey), 'DerivedFrom', 1, 0.9, 0 from customer union all select concat('s', s_suppkey), concat('n', s_nationkey), 'DerivedFrom', 1, 0.8, 0 from supplier union all
        select concat('o', o_orderkey), concat('c', o_custkey), 'DerivedFrom', 1, 0.7, 0 from orders union all
        select concat('o', l_orderkey), concat('p', l_partkey), 'AggregatedFrom', 1 - max(l_discount), 1, l_partkey from lineitem group by l_orderkey, l_partkey union all
        select concat('p', l_partkey), concat('s', l_suppkey), 'AggregatedFrom', 1 - max(l_discount), 1, l_suppkey from lineitem group by l_partkey, l_suppkey"""),
    "doc_nodes": (("documents",), "select concat('d', doc_id) as id, doc_id as num, md5(text) as hash, concat(source, '/', lang, '/', doc_id, '.txt') as path from documents"),
    "doc_edges": (("documents",), """
        select concat('d', a.doc_id) as from_node_id, concat('d', b.doc_id) as to_node_id, 'DuplicateOf' as type, cast(1 as double) as weight, cast(1 as double) as confidence, b.doc_id as seq from (
          select doc_id, text, min(doc_id) over (partition by md5(text)) as first from documents) b join documents a on a.doc_id = b.first where b.doc_id > b.first"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of nodes or edges. Names of tables are bound to the files; no view is left behind."""
    tables, sql = GRAPHS[name]
    import re

    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select concat('u', user_id) as node_id, ts, map('AvgLatencyMs', value, 'ItemsFailed', cast(case when event_type = 'error' then 1 else 0 end as double)) as values from {events}", events=table(spark, sf_dir, "events"))


def cte(*names: str) -> str:
    """The same tables for the oracle."""
    return "with recursive " + ", ".join(f"{n} as ({GRAPHS[n][1]})" for n in names)
