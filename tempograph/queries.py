"""Queries of the graph engine on the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .defaults import EngineConfig
from .functions import scores as S
from .functions.classify import edge_type, node_type
from .operators import centrality, community, connectivity, health, traversal
from .operators.query import GraphQuery
from .plans.loop import shared_dir
from .sources.fixtures import cte, graph, metrics, table
from .sources.pipeline import PipelineMonitor, emit_edges, graph_sink, graph_source, sink_stream
from .sources.store import Drained, GraphStore, degraded_nodes, properties_json, pseudo_edges, steps_json, weakened_edges
from .streaming.metrics import agent_round, consume

NOW = "2024-02-01 00:00:00"
AT, SPAN = "2024-01-10 12:00:00", ("2024-01-05 00:00:00", "2024-01-06 00:00:00")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def events(spark, d) -> GraphQuery:
    return GraphQuery(graph(spark, d, "event_nodes"), graph(spark, d, "event_edges"))


def commerce(spark, d) -> GraphQuery:
    return GraphQuery(graph(spark, d, "commerce_nodes"), graph(spark, d, "commerce_edges"))


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


NODE_SQL = cte("event_nodes") + " select id, type, round(health_score, 6) as health_score, valid_from from event_nodes where "


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "type", *r6("health_score"), "valid_from")


@query(NODE_SQL + "type = 'click'")
def n1_type(spark, d):
    return shown(events(spark, d).nodes("click").find_nodes())


@query(NODE_SQL + "health_score < 0.8")
def n2_lt(spark, d):
    return shown(events(spark, d).where("HealthScore", "LessThan", 0.8).find_nodes())


@query(NODE_SQL + "predicted_latency_ms > 150")
def n2_gt(spark, d):
    return shown(events(spark, d).where("PredictedLatencyMs", "GreaterThan", 150).find_nodes())


@query(NODE_SQL + "abs(health_score - 0.9) < 0.001")
def n2_eq_tol(spark, d):
    return shown(events(spark, d).where("HealthScore", "Equals", 0.9).find_nodes())


@query(NODE_SQL + "0.0 < 1")
def n2_unknown_property(spark, d):
    return shown(events(spark, d).where("Nope", "LessThan", 1).find_nodes())


@query(NODE_SQL + "health_score < 0.9 and failure_prob > 0.5")
def n3_and(spark, d):
    return shown(events(spark, d).where("HealthScore", "LessThan", 0.9).and_().where("FailureProb", "GreaterThan", 0.5).find_nodes())


@query(NODE_SQL + "(health_score < 0.7 or health_score > 0.99) and failure_prob > 0.5")
def n4_or(spark, d):
    q = events(spark, d).where("HealthScore", "LessThan", 0.7).or_().where("HealthScore", "GreaterThan", 0.99)
    return shown(q.where("FailureProb", "GreaterThan", 0.5).find_nodes())


@query(NODE_SQL + f"valid_from <= timestamp '{AT}' and (valid_to is null or valid_to >= timestamp '{AT}')")
def n5_asof(spark, d):
    return shown(events(spark, d).as_of(AT).find_nodes())


@query(NODE_SQL + f"valid_from between timestamp '{SPAN[0]}' and timestamp '{SPAN[1]}' or valid_to between timestamp '{SPAN[0]}' and timestamp '{SPAN[1]}'")
def n6_between(spark, d):
    return shown(events(spark, d).between(*SPAN).find_nodes())


@query(NODE_SQL + f"type = 'purchase' and health_score < 0.95 and valid_from <= timestamp '{AT}' and (valid_to is null or valid_to >= timestamp '{AT}') order by event_nodes.health_score desc, id limit 20")
def n7_order_limit(spark, d):
    return shown(events(spark, d).nodes("purchase").where("HealthScore", "LessThan", 0.95).as_of(AT).order_by("HealthScore", descending=True).limit(20).find_nodes())


@query(NODE_SQL + "true order by valid_from, id limit 50")
def n8_limit(spark, d):
    return shown(events(spark, d).order_by("CreatedAt").limit(50).find_nodes())


EDGE_COLUMNS = "from_node_id, to_node_id, type, round(weight, 6) as weight"


@query(cte("event_edges") + f" select {EDGE_COLUMNS} from event_edges where type = 'FeedsInto' and valid_from <= timestamp '{AT}' and (valid_to is null or valid_to > timestamp '{AT}')")
def n10_edges_asof(spark, d):
    return events(spark, d).as_of(AT).find_edges("FeedsInto").select("from_node_id", "to_node_id", "type", *r6("weight"))


@query(NODE_SQL + "id = 'e5'")
def s6_point_lookup(spark, d):
    store = GraphStore.in_memory(spark)
    store.upsert_nodes(graph(spark, d, "event_nodes").drop("num"), NOW)
    return shown(store.node("e5"))


@query(cte("handoff") + f" select {EDGE_COLUMNS} from handoff where from_node_id = 'u1' and weight < 0.3")
def s15_weakened(spark, d):
    return weakened_edges(graph(spark, d, "handoff"), "u1").select("from_node_id", "to_node_id", "type", *r6("weight"))


@query(NODE_SQL + "health_score < 0.7 and valid_to is null")
def s16_degraded(spark, d):
    return shown(degraded_nodes(graph(spark, d, "event_nodes")))


def bfs_sql(where: str, start: str, depth: int, limit: int, start_ok: str = "true") -> str:
    return cte("commerce_nodes", "commerce_edges") + f""", e as (select from_node_id as src, to_node_id as dst, seq from commerce_edges join commerce_nodes n on n.id = to_node_id where {where}),
      w(id, depth, place) as (select '{start}', 0, cast([] as bigint[]) union all select e.dst, depth + 1, list_append(place, e.seq) from w join e on e.src = w.id where depth < {depth}),
      b as (select *, row_number() over (partition by id order by depth, place) as rn from w)
      select cast(row_number() over (order by depth, place) - 1 as int) as position, id, depth from b where rn = 1 and (depth > 0 or {start_ok}) order by depth, place limit {limit}"""


@query(bfs_sql("true", "o1", 4, 1000))
def t2_traverse(spark, d):
    q = commerce(spark, d)
    return traversal.traverse(q.node_table, q.edge_table, "o1", edge_type=None, max_depth=4, limit=1000)


@query(bfs_sql("commerce_edges.type = 'AggregatedFrom'", "o1", 2, 7))
def t2_traverse_limit(spark, d):
    return commerce(spark, d).start_from("o1").traverse("AggregatedFrom", 2).limit(7).execute()


@query(bfs_sql("commerce_edges.type = 'AggregatedFrom' and commerce_edges.weight >= 0.95", "o2", 2, 100))
def t4_min_weight(spark, d):
    return commerce(spark, d).start_from("o2").traverse("AggregatedFrom", 2).with_min_weight(0.95).execute()


@query(bfs_sql("commerce_edges.type = 'DerivedFrom' and confidence >= 0.8", "c7", 3, 100))
def t5_min_confidence(spark, d):
    return commerce(spark, d).start_from("c7").traverse("DerivedFrom", 3).with_min_confidence(0.8).execute()


@query(bfs_sql("commerce_edges.type = 'AggregatedFrom' and n.health_score > 0.5", "o1", 2, 100))
def t6_node_filter(spark, d):
    return commerce(spark, d).start_from("o1").traverse("AggregatedFrom", 2).where_node("health_score > 0.5").execute()


@query(cte("commerce_nodes", "commerce_edges") + """, t as (select concat('r', n_regionkey) as target from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderkey = 1),
  w(id, depth, place, path, types, weights) as (select 'o1', 0, cast([] as bigint[]), ['o1'], cast([] as varchar[]), cast([] as double[]) union all
    select e.to_node_id, depth + 1, list_append(place, e.seq), list_append(path, e.to_node_id), list_append(types, e.type), list_append(weights, e.weight) from w join commerce_edges e on e.from_node_id = w.id where depth < 5),
  b as (select * from w join t on w.id = t.target order by depth, place limit 1),
  u as (select unnest(range(0, len(path))) as i, * from b)
  select cast(i as int) as position, path[i + 1] as id, types[i] as edge_type, round(case when i = 0 then 0 else weights[i] end, 6) as weight, round(list_sum(weights), 6) as total_weight from u""")
def t1_shortest_path(spark, d):
    q = commerce(spark, d)
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    region = orders.filter("o_orderkey = 1").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    target = region.select(F.concat(F.lit("r"), "n_regionkey")).first()[0]
    out = traversal.shortest_path(q.node_table, q.edge_table, "o1", target, edge_type=None, max_depth=5)
    return out.select("position", "id", "edge_type", *r6("weight", "total_weight"))


@query(cte("user_nodes", "handoff") + " select id, count(h.from_node_id) as degree from user_nodes left join handoff h on h.from_node_id = id group by id")
def a1_degree(spark, d):
    return centrality.out_degree(graph(spark, d, "user_nodes"), graph(spark, d, "handoff"))


def pagerank_sql(steps: int) -> str:
    sql = cte("user_nodes", "handoff") + ", n as (select count(*) as n from user_nodes), deg as (select from_node_id, count(*) as k from handoff group by 1), r0 as materialized (select id, 1.0 / n as rank from user_nodes, n)"
    for i in range(steps):
        sql += f", r{i + 1} as materialized (select u.id, 0.15 / any_value(n.n) + 0.85 * coalesce(sum(r.rank / deg.k), 0) as rank from user_nodes u cross join n left join handoff h on h.to_node_id = u.id left join deg on deg.from_node_id = h.from_node_id left join r{i} r on r.id = h.from_node_id group by u.id)"
    return sql + f" select id, round(rank, 6) as rank from r{steps}"


@query(pagerank_sql(10))
def a2_pagerank(spark, d):
    return centrality.pagerank(graph(spark, d, "user_nodes"), graph(spark, d, "handoff"), tolerance=None, max_iterations=10).select("id", *r6("rank"))


DISTANCES = cte("user_nodes", "handoff_groups") + """, e as (select from_node_id as src, to_node_id as dst from handoff_groups),
  reach(s, t, d) as (select id, id, 0 from user_nodes union select s, e.dst, d + 1 from reach join e on e.src = t where d < 60),
  dist as materialized (select s, t, min(d) as d from reach group by s, t), walks(s, t, d) as (select id, id, 0 from user_nodes union all select w.s, e.dst, w.d + 1 from walks w join e on e.src = w.t join dist on dist.s = w.s and dist.t = e.dst and dist.d = w.d + 1),
  sigma as materialized (select s, t, any_value(d) as d, cast(count(*) as double) as n from walks group by s, t)"""
BETWEEN = DISTANCES + " , sc as (select a.t as id, sum(a.n * b.n / c.n) as score from sigma a join sigma b on a.t = b.s join sigma c on c.s = a.s and c.t = b.t and c.d = a.d + b.d where a.s <> a.t and b.t <> a.t {} group by a.t) select id, round(coalesce(score, 0), 6) as score from user_nodes left join sc using (id)"


@query(BETWEEN.format(""))
def a3_betweenness(spark, d):
    return centrality.betweenness(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups")).select("id", *r6("score"))


@query(BETWEEN.format("and a.s in ('u1', 'u2', 'u3', 'u4', 'u5')"))
def a4_betweenness_subset(spark, d):
    n = graph(spark, d, "user_nodes")
    return centrality.betweenness(n, graph(spark, d, "handoff_groups"), n.filter("id in ('u1', 'u2', 'u3', 'u4', 'u5')")).select("id", *r6("score"))


CLOSE = DISTANCES + " select s as id, round(case when sum(d) > 0 then ((select count(*) from user_nodes) - 1) / cast(sum(d) as double) else 0 end, 6) as score from dist where {} group by s"


@query(CLOSE.format("true"))
def a5_closeness(spark, d):
    return centrality.closeness(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups")).select("id", *r6("score"))


@query(CLOSE.format("s in ('u1', 'u2')"))
def a6_closeness_subset(spark, d):
    n = graph(spark, d, "user_nodes")
    return centrality.closeness(n, graph(spark, d, "handoff_groups"), n.filter("id in ('u1', 'u2')")).select("id", *r6("score"))


def _parity(spark, d):
    return graph(spark, d, "user_nodes").select("id", F.when(F.substring("id", 2, 9).cast("int") % 3 > 0, F.substring("id", 2, 9).cast("int") % 3).alias("community"))


@query(cte("user_nodes") + " select id, cast(substr(id, 2) as int) % 3 as community, round(health_score, 6) as health_score from user_nodes order by 2, user_nodes.health_score desc, id")
def a7_by_community(spark, d):
    return centrality.by_community(graph(spark, d, "user_nodes"), _parity(spark, d)).select("id", F.coalesce("community", F.lit(0)).alias("community"), *r6("health_score"))


@query(cte("user_nodes", "handoff") + " select id, count(h.from_node_id) as degree from user_nodes left join handoff h on h.from_node_id = id group by id order by 2 desc, id")
def a8_by_degree(spark, d):
    return centrality.by_degree(graph(spark, d, "user_nodes"), graph(spark, d, "handoff")).select("id", "degree")


@query(cte("user_nodes") + " select id, round(health_score, 6) as health_score from user_nodes order by user_nodes.health_score desc, id")
def a9_by_accessibility(spark, d):
    return centrality.by_accessibility(graph(spark, d, "user_nodes")).select("id", *r6("health_score"))


@query(cte("user_nodes", "handoff") + ", k as (select id, coalesce(sum(weight), 0) as k from user_nodes left join handoff on from_node_id = id group by id), q as (select -sum(k * k) / (4 * sum(k) * sum(k)) as q from k) select id, [id] as node_ids, 1 as size, round(q, 6) as modularity from user_nodes, q")
def a10_clusters_reference(spark, d):
    n, e = graph(spark, d, "user_nodes"), graph(spark, d, "handoff")
    return community.cluster_table(community.clusters(n, e), e).select("id", "node_ids", "size", *r6("modularity"))


@query()
def a10_clusters_modularity(spark, d):
    n, e = graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups")
    return community.clusters(n, e, mode="modularity")


@query(cte("handoff") + """, m as (select cast(substr(id, 2) as int) % 3 as c, id from (select from_node_id as id from handoff union select to_node_id from handoff) x),
  e as (select a.c as cs, b.c as cd, weight from handoff join m a on a.id = from_node_id join m b on b.id = to_node_id), t as (select sum(weight) as m from e),
  by_c as (select cs, sum(weight) as o, coalesce(sum(weight) filter (where cs = cd), 0) as i from e group by cs) select round(sum(i / m - o * o / (4 * m * m)), 6) as q from by_c, t""")
def a11_modularity(spark, d):
    m = graph(spark, d, "user_nodes").select("id", (F.substring("id", 2, 9).cast("int") % 3).alias("community"))
    return community.modularity(graph(spark, d, "handoff"), m).select(*r6("q"))


@query(cte("commerce_nodes", "commerce_edges") + ", w(id, level) as (select id, 0 from commerce_nodes where id not in (select to_node_id from commerce_edges) union select e.to_node_id, level + 1 from w join commerce_edges e on e.from_node_id = w.id) select id, cast(max(level) as int) as level, false as is_cyclic from w group by id")
def a12_topological(spark, d):
    return connectivity.topological_order(graph(spark, d, "commerce_nodes"), graph(spark, d, "commerce_edges"))


CLOSURE = cte("user_nodes", "handoff_groups") + ", p(a, b) as (select from_node_id, to_node_id from handoff_groups union select p.a, e.to_node_id from p join handoff_groups e on e.from_node_id = p.b)"
CYCLIC = CLOSURE + ", cyc as (select a from p where a = b), bad as (select a as id from cyc union select p.b from p join cyc on p.a = cyc.a)"


@query(CYCLIC + " select id from bad")
def a13_cyclic(spark, d):
    return connectivity.topological_order(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups")).filter("is_cyclic").select("id")


@query(CYCLIC + " select count(*) > 0 as has_cycles from bad")
def a14_has_cycles(spark, d):
    return connectivity.has_cycles(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups"))


SCC = CLOSURE + " select u.id, coalesce(least(u.id, min(x.b)), u.id) as component from user_nodes u left join (select p.a, p.b from p join p q on q.a = p.b and q.b = p.a) x on x.a = u.id group by u.id"


@query(SCC)
def a15_scc(spark, d):
    return connectivity.strong_components(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups"))


@query(cte("user_nodes", "handoff_groups") + ", s as (select from_node_id as a, to_node_id as b from handoff_groups union select to_node_id, from_node_id from handoff_groups), p(a, b) as (select a, b from s union select p.a, s.b from p join s on s.a = p.b) select id, coalesce(least(id, min(b)), id) as component from user_nodes left join p on p.a = id group by id")
def a16_wcc(spark, d):
    return connectivity.weak_components(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups"))


@query(cte("handoff") + " select from_node_id as id, count(distinct to_node_id) as neighbours, true as within_5_percent from handoff group by 1")
def a17_hll(spark, d):
    e = graph(spark, d, "handoff")
    exact = e.groupBy(F.col("from_node_id").alias("id")).agg(F.count_distinct("to_node_id").alias("neighbours"))
    return centrality.distinct_neighbours(e).join(exact, "id").select("id", "neighbours", (F.abs(F.col("estimate") - F.col("neighbours")) <= F.greatest(0.05 * F.col("neighbours"), F.lit(1))).alias("within_5_percent"))


@query("select event_id, case when event_id % 4 = 0 then 'File' when event_id % 4 = 1 then 'DatabaseRecord' when event_id % 4 = 2 then 'Stream' else 'Unknown' end as node_type from events")
def c1_node_type(spark, d):
    p = F.expr("""parse_json(case event_id % 4 when 0 then '{"hash": null, "path": "x"}' when 1 then '{"sql": 1}' when 2 then '{"stream": true}' else '{"hash": 1}' end)""")
    return table(spark, d, "events").select("event_id", node_type(p).alias("node_type"))


@query("""with p as (select doc_id, md5(text) as h, lead(md5(text)) over w as h2, concat(source, '_', lang) as b, lead(concat(source, '_', lang)) over w as b2 from documents window w as (order by doc_id))
  select doc_id, case when h = h2 then 'DuplicateOf' when starts_with(b, b2) or starts_with(b2, b) then 'VersionOf' else 'DerivedFrom' end as edge_type from p where h2 is not null""")
def c2_edge_type(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.md5("text").alias("hash"), F.concat(F.lit("/a.b/"), "source", F.lit("_"), "lang", F.lit(".txt")).alias("path"))).alias("p"))
    return docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q")), "doc_id").select("doc_id", edge_type(F.parse_json("p"), F.parse_json("q")).alias("edge_type"))


VECTORS = cte("handoff") + """, m as (select concat('u', user_id) as node_id, ts, value, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, value) as i, count(*) over (partition by user_id) as n from events),
  a as (select node_id, list(value order by ts, value) as xs, avg(case when bad then 1.0 else 0.0 end) as failure_prob, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99, count(*) as n from m group by node_id),
  ema(node_id, i, xs, s1, s2, n) as (select node_id, 1, xs, xs[1], xs[1], n from a union all select node_id, i + 1, xs, 0.2 * xs[i + 1] + 0.8 * s1, 0.2 * (0.2 * xs[i + 1] + 0.8 * s1) + 0.8 * s2, n from ema where i < n),
  f as (select node_id, 2 * s1 - s2 + 0.25 * (s1 - s2) as pred from ema where i = n), wk as (select from_node_id, count(*) as k from handoff where weight < 0.3 group by 1),
  v as (select a.node_id, a.n, failure_prob, p50, p95, p99, pred, least(coalesce(k, 0) / 100.0, 1) as strain from a join f using (node_id) left join wk on wk.from_node_id = a.node_id),
  s as (select *, greatest(least(1 - (0.35 * failure_prob + 0.35 * least(pred / 1000, 1) + 0.3 * strain), 1), 0) as score from v)"""


@query(VECTORS + " select node_id, round(failure_prob, 6) as failure_prob, round(p50, 6) as p50, round(p95, 6) as p95, round(p99, 6) as p99, round(pred, 6) as predicted_latency_ms, round(strain, 6) as resource_strain, round(score, 6) as health_score from s")
def h3_health_vectors(spark, d):
    v = health.health_vectors(metrics(spark, d), graph(spark, d, "handoff"))
    return v.select("node_id", *r6("failure_prob", "p50", "p95", "p99", "predicted_latency_ms", "resource_strain", "health_score"))


@query(cte("event_nodes") + " select id, round(greatest(least(1 - (0.35 * failure_prob + 0.35 * least(predicted_latency_ms / 1000, 1) + 0.3 * resource_strain), 1), 0), 9) as score from event_nodes")
def h1_score(spark, d):
    return graph(spark, d, "event_nodes").select("id", F.round(S.health_score(F.col("failure_prob"), F.col("predicted_latency_ms"), F.col("resource_strain")), 9).alias("score"))


@query(cte("event_nodes") + " select id, round(greatest(least(1 - (0.5 * failure_prob + 0.3 * least(predicted_latency_ms / 1000, 1) + 0.2 * resource_strain), 1), 0), 9) as score from event_nodes")
def h2_custom_weights(spark, d):
    return graph(spark, d, "event_nodes").select("id", F.round(S.health_score(F.col("failure_prob"), F.col("predicted_latency_ms"), F.col("resource_strain"), (0.5, 0.3, 0.2)), 9).alias("score"))


PREDICT = """with c as (select event_id, user_id, ts, value, 1 - least(value / 500, 1) as s, case when event_type = 'error' then 1.0 else 0.0 end as f, lag(value) over w as v0, lag(ts) over w as t0 from events window w as (partition by user_id order by ts, event_id)),
  p as (select *, case when v0 is null then 0 else 1 - least(v0 / 500, 1) - s end as dh, value - coalesce(v0, value) as dl, (epoch_us(ts) - epoch_us(coalesce(t0, ts))) / 1e6 as dt, value > 150 or s < 0.3 as hot from c),
  r as (select *, least(0.4 * greatest(dh, 0) + 0.3 * greatest(dl / 1000, 0) + 0.3 * f, 1) as conf, case when dl > 0 and dt > 0 then (150 - value) / (dl / dt) * 1000 end as tti from p)"""


def _predictions(spark, d):
    n = table(spark, d, "events").selectExpr("event_id", "concat('u', user_id) as node_id", "ts", "1 - least(value / 500, 1) as health_score", "value as predicted_latency_ms", "case when event_type = 'error' then 1D else 0D end as failure_prob")
    return health.predict_bottlenecks(n, n, latency_limit=150.0)


@query(PREDICT + " select event_id, hot as is_bottleneck, round(dh, 6) as health_delta, round(dl, 6) as latency_delta, round(conf, 6) as confidence, round(tti, 3) as time_to_impact_ms from r")
def h6_bottlenecks(spark, d):
    finite = F.when(F.col("time_to_impact_ms") != float("inf"), F.col("time_to_impact_ms"))
    return _predictions(spark, d).select("event_id", "is_bottleneck", *r6("health_delta", "latency_delta", "confidence"), F.round(finite, 3).alias("time_to_impact_ms"))


@query(PREDICT + " select concat('u', user_id) as node_id, case when hot then 'BottleneckPrediction' else 'HealthDegradation' end as type, case when hot then 'Critical' else 'Warning' end as severity, round(conf, 6) as confidence from r where hot or dh > 0.1")
def h10_insights(spark, d):
    return health.insights_of(_predictions(spark, d), NOW).select(F.get("related_node_ids", F.lit(0)).alias("node_id"), "type", "severity", *r6("confidence"))


#: What kind of insight stands for each type of event, as SQL.
KIND = "case event_type when 'error' then 'BottleneckPrediction' when 'click' then 'HealthDegradation' when 'view' then 'AnomalyDetected' when 'purchase' then 'RetryBudgetExhausted' else 'ClusterDiscovered' end"


def _insights(spark, d):
    """An insight for each event of its user and the next one."""
    e = table(spark, d, "events")
    return e.selectExpr("concat('i', event_id) as id", f"{KIND} as type", "'t' as title", "'d' as description", "array(concat('u', user_id), concat('u', user_id + 1)) as related_node_ids", "value / 1000 as confidence", "'Warning' as severity", "ts as generated_at")


@query(f"""with e as (select *, epoch_us(ts) as t from events), s as (select max(t) - (max(t) - min(t)) // 8 as start from e),
  i as (select concat('i', event_id) as id, {KIND} as type, [concat('u', user_id), concat('u', user_id + 1)] as n, value / 1000 as c, t >= start as late from e, s),
  x as (select id, type, n, c, late, unnest(n) as node from i), p as (select distinct a.id, b.id as o, b.c as oc, b.n as bn from x a join x b on a.late and not b.late and a.type = b.type and a.node = b.node),
  g as (select id, count(*) + 1 as k, sum(oc) as s, flatten(list(bn)) as more from p group by id),
  j as (select i.id, type, n, c, coalesce(k, 1) as k, coalesce(s, 0) as s, more from i left join g using (id) where late)
  select case when k >= 5 then 'consolidated_' || id else id end as id, type, round(case when k >= 5 then least((c + s) / k + 0.1 * (k - 5), 1) else c end, 6) as confidence, case when k >= 5 then array_to_string(list_sort(list_distinct(list_concat(n, more))), ',') else array_to_string(n, ',') end as nodes from j""")
def h14_consolidate(spark, d):
    """The insights of the last eighth of the table's time against all earlier ones."""
    e = table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    start = e.agg((F.max("t") - F.expr("(max(t) - min(t)) div 8")).alias("start")).first()[0]
    late = F.coalesce(F.unix_micros(F.col("generated_at").cast("timestamp")) >= F.lit(start), F.lit(False))
    i = _insights(spark, d)
    out = health.consolidate(i.filter(late), i.filter(~late))
    return out.select("id", "type", *r6("confidence"), F.array_join("related_node_ids", ",").alias("nodes"))


@query()
def h15_consolidate_all(spark, d):
    return health.consolidate_all(_insights(spark, d)).select("id", "type", *r6("confidence"), F.size("related_node_ids").alias("n_nodes"))


@query(cte("event_edges") + f""" select to_node_id, round(greatest(weight * pow(0.5, (epoch_us(timestamp '{NOW}') - epoch_us(valid_from)) / 1e6 / (2592000 * (1 + 0.1 * (seq % 5)))), 0.1), 6) as decayed_weight,
  greatest(weight * pow(0.5, (epoch_us(timestamp '{NOW}') - epoch_us(valid_from)) / 1e6 / (2592000 * (1 + 0.1 * (seq % 5)))), 0.1) < 0.3 as is_weakened from event_edges""")
def h16_decay(spark, d):
    return health.decay(graph(spark, d, "event_edges"), NOW, access=F.col("seq") % 5).select("to_node_id", *r6("decayed_weight"), "is_weakened")


@query(cte("event_edges") + f" select to_node_id, round(case when seq % 3 = 0 then greatest(weight * 0.5, 0.1) else weight end, 6) as weight, case when seq % 3 = 0 then 0.8 else confidence end as confidence, case when seq % 3 = 0 then timestamp '{NOW}' else valid_to end as valid_to from event_edges")
def h18_resolve(spark, d):
    e = graph(spark, d, "event_edges")
    return health.resolve_conflicts(e, e.filter("seq % 3 = 0"), NOW).select("to_node_id", *r6("weight"), "confidence", "valid_to")


@query("""with v as (select user_id, event_type, ts, count(*) as c from events group by all), s as (select user_id, event_type, sum(c) as n, sum(c * c) as sq, count(*) as k from v group by all)
  select concat('u', user_id) as from_node_id, event_type as to_node_id, cast(n as bigint) as n, cast((n * n - sq) / 2 as bigint) as n_conflicts from s where k > 1""")
def h19_conflicts(spark, d):
    e = table(spark, d, "events").selectExpr("concat('u', user_id) as from_node_id", "event_type as to_node_id", "'FeedsInto' as type", "ts as valid_from")
    return health.conflicts(e).select("from_node_id", "to_node_id", "n", "n_conflicts")


def _versions(spark, d, store: GraphStore) -> None:
    """Two batches of user nodes: all, then those of odd number again."""
    n = graph(spark, d, "user_nodes").select("id", "type", "health_score")
    store.upsert_nodes(n, "2024-01-01 00:00:00")
    store.upsert_nodes(n.filter("substring(id, 2) % 2 = 1").withColumns({"label": F.lit("again"), "version": F.lit(2)}), "2024-01-02 00:00:00")


@query(cte("user_nodes") + " select id, case when cast(substr(id, 2) as int) % 2 = 1 then 'again' else '' end as label, case when cast(substr(id, 2) as int) % 2 = 1 then 3 else 2 end as version from user_nodes")
def s4_upsert(spark, d):
    store = GraphStore.in_memory(spark)
    _versions(spark, d, store)
    return store.nodes().select("id", "label", "version")


@query(cte("user_nodes", "handoff_groups") + " select 'node' as kind, id, '' as target from user_nodes where id <> 'u1' union all select 'edge', from_node_id, to_node_id from handoff_groups where from_node_id <> 'u1' and to_node_id <> 'u1'")
def s7_delete_cascade(spark, d):
    store = GraphStore.from_dataframes(spark, graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups"), NOW)
    store.delete_nodes(store.node("u1"), "2024-02-02 00:00:00")
    return store.nodes().select(F.lit("node").alias("kind"), "id", F.lit("").alias("target")).unionAll(store.edges().select(F.lit("edge"), "from_node_id", "to_node_id"))


@query(cte("handoff_groups") + " select from_node_id, to_node_id, case when seq % 2 = 0 then 0.5 else weight end as weight, seq from handoff_groups")
def s8_edge_upsert(spark, d):
    store, e = GraphStore.in_memory(spark), graph(spark, d, "handoff_groups")
    store.upsert_edges(e, "2024-01-01 00:00:00")
    store.upsert_edges(e.filter("seq % 2 = 0").withColumns({"weight": F.lit(0.5), "seq": F.lit(None).cast("bigint")}), "2024-01-02 00:00:00")
    return store.edges().select("from_node_id", "to_node_id", "weight", "seq")


@query("select concat('u', user_id) as from_node_id, concat('i', event_id) as to_node_id, 'FeedsInto' as type, round(value / 1000, 6) as weight from events where event_type = 'error'")
def s12_insight_edges(spark, d):
    store = GraphStore.in_memory(spark)
    store.insert_insights(_insights(spark, d))
    return pseudo_edges(store.insights("BottleneckPrediction")).select("from_node_id", "to_node_id", "type", *r6("weight"))


@query(cte("user_nodes") + " select id, case when cast(substr(id, 2) as int) % 2 = 1 then 0.25 else round(health_score, 6) end as health_score, case when cast(substr(id, 2) as int) % 2 = 1 then 3 else 2 end as version from user_nodes")
def s13_health_update(spark, d):
    store = GraphStore.in_memory(spark)
    _versions(spark, d, store)
    new = store.nodes().filter("label = 'again'").select("id", F.lit(0.25).alias("health_score"), *(F.lit(0.0).alias(c) for c in ("failure_prob", "predicted_latency_ms", "resource_strain")), F.lit(3).alias("expected_version"))
    store.update_node_health(new, "2024-01-03 00:00:00")
    return store.nodes().select("id", *r6("health_score"), "version")


@query(VECTORS + " select node_id, cast(n as bigint) as n, round(failure_prob, 6) as failure_prob, round(pred, 6) as predicted_latency_ms, round(strain, 6) as resource_strain, round(score, 6) as health_score from s")
def m2_consumer(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    rows = stream.selectExpr("concat('u', user_id) as node_id", "ts", "map('AvgLatencyMs', value, 'ItemsFailed', cast(case when event_type = 'error' then 1 else 0 end as double)) as values")
    return consume(spark, rows, graph(spark, d, "handoff")).select("node_id", "n", *r6("failure_prob", "predicted_latency_ms", "resource_strain", "health_score"))


@query("select concat('i', event_id) as id, 'AnomalyDetected' as type, round(value / 1000, 6) as confidence from events where event_type = 'view' order by ts, concat('i', event_id) limit 25")
def n14_find_insights(spark, d):
    store = GraphStore.in_memory(spark)
    store.insert_insights(_insights(spark, d))
    return store.query().insights("AnomalyDetected").limit(25).execute().select("id", "type", *r6("confidence"))


@query(NODE_SQL + "valid_to is null")
def s3_reload_open(spark, d):
    """A store written at a path, closed, and opened again: rows whose validity hasn't ended."""
    store = GraphStore.open(spark, shared_dir(spark, "reopened"))
    store.upsert_nodes(graph(spark, d, "event_nodes").drop("num"), NOW)
    store.close()
    return shown(GraphStore.from_config(spark, EngineConfig(path=store.path)).open_nodes())


@query(cte("handoff_groups") + ", gone as (select from_node_id as f, to_node_id as t from handoff_groups where seq = (select min(seq) from handoff_groups)) select from_node_id, to_node_id, seq from handoff_groups where (from_node_id, to_node_id) not in (select f, t from gone)")
def s9_delete_edge(spark, d):
    store = GraphStore.in_memory(spark)
    store.upsert_edges(graph(spark, d, "handoff_groups"), "2024-01-01 00:00:00")
    first = store.edges().agg(F.min_by("id", "seq")).first()[0]
    store.delete_edge(first, "2024-01-02 00:00:00")
    return store.edges().select("from_node_id", "to_node_id", "seq")


@query("select state, health, takes_writes from (values ('Running', 'Healthy', true), ('Draining', 'Degraded', false), ('Drained', 'Healthy', false), ('Faulted', 'Unhealthy', false)) v(state, health, takes_writes)")
def s14_states(spark, d):
    """Every state that a store comes to, its health, and whether it then takes a batch of nodes."""
    seen = []

    def note(store):
        try:
            store.upsert_nodes(spark.createDataFrame([("x",)], "id string"), NOW)
            takes = True
        except Drained:
            takes = False
        seen.append((store.state, health.store_health(store.state), takes))

    class Stream:
        def stop(self):
            note(store)

    store, other = GraphStore.in_memory(spark), GraphStore.in_memory(spark)
    note(store)
    store.attach(Stream())
    store.drain()
    note(store)
    try:
        other.insert_metrics(spark.range(1).selectExpr("'x' as node_id", "'no time' as ts", "map('a', 1D) as values"))
    except Exception:
        note(other)
    return spark.createDataFrame(seen, "state string, health string, takes_writes boolean")


@query(cte("user_nodes", "handoff_groups") + " select 'node' as kind, id as a, '' as b, case when cast(substr(id, 2) as int) % 2 = 1 then 3 else 2 end as version from user_nodes union all select 'edge', from_node_id, to_node_id, 0 from handoff_groups")
def s14_compact(spark, d):
    store = GraphStore.in_memory(spark)
    _versions(spark, d, store)
    store.upsert_edges(graph(spark, d, "handoff_groups"), "2024-01-03 00:00:00")
    small = store.compact(drop=True)
    return small.nodes().select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), "version").unionAll(small.edges().select(F.lit("edge"), "from_node_id", "to_node_id", F.lit(0)))


@query(cte("commerce_nodes") + " select id, type, round(health_score, 6) as health_score from commerce_nodes where type = 'Supplier'")
def s17_source(spark, d):
    store = GraphStore.in_memory(spark)
    store.upsert_nodes(graph(spark, d, "commerce_nodes"), NOW)
    return graph_source(store, "Supplier").select("id", "type", *r6("health_score"))


RESULTS = ("event_type <> 'error' as is_success", "case when event_id % 7 > 0 then named_struct('id', concat('e', event_id), 'kind', event_type) end as value")
SINK_SQL = "select concat('e', event_id) as id, event_type as type, 2 as version from events where event_type <> 'error' and event_id % 7 > 0"


def _to_node():
    return {"id": F.col("value.id"), "type": F.col("value.kind")}


@query(SINK_SQL)
def s18_sink(spark, d):
    store = GraphStore.in_memory(spark)
    graph_sink(table(spark, d, "events").selectExpr(*RESULTS), store, _to_node(), NOW)
    return store.nodes().select("id", "type", "version")


def _event_stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(d)


@query(SINK_SQL)
def s18_sink_stream(spark, d):
    store = GraphStore.in_memory(spark)
    sink_stream(_event_stream(spark, d).selectExpr(*RESULTS), store, _to_node(), lambda: NOW, shared_dir(spark, "sink")).awaitTermination()
    return store.nodes().select("id", "type", "version")


@query("select concat('u', user_id) as from_node_id, concat('e', min(event_id)) as to_node_id, count(*) as n_rows from events group by user_id")
def s19_emit_edges(spark, d):
    """The rows pass through, and each has left an edge."""
    store = GraphStore.in_memory(spark)
    firsts = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n_rows"))
    passed = emit_edges(firsts, store, {"from_node_id": F.concat(F.lit("u"), "user_id"), "to_node_id": F.concat(F.lit("e"), "event_id"), "type": F.lit("FeedsInto")}, NOW)
    rows = passed.select(F.concat(F.lit("u"), "user_id").alias("from_node_id"), "n_rows")
    return store.edges().join(rows, "from_node_id").select("from_node_id", "to_node_id", "n_rows")


@query("select 'pipeline_events_nodes' as id, 'Pipeline' as type, cast(count(*) as double) as items, cast(count(*) filter (where event_type = 'error') as double) as failed, 'Drained' as state from events")
def s20_attach_pipeline(spark, d):
    """A watched stream: its node, the metrics that are in the store when it has ended, and the store's state."""
    store = GraphStore.in_memory(spark)
    monitor = PipelineMonitor(store, "events", "nodes", lambda: NOW)
    monitor.finish(monitor.watch(lambda: sink_stream(_event_stream(spark, d).selectExpr(*RESULTS), store, _to_node(), lambda: NOW, shared_dir(spark, "sink"))))
    m = store.metric_entries().groupBy(F.col("node_id").alias("id")).agg(*(F.sum(F.col("values")[k]).alias(n) for k, n in (("ItemsProcessed", "items"), ("ItemsFailed", "failed"))))
    return store.nodes().join(m, "id").select("id", "type", "items", "failed", F.lit(store.state).alias("state"))


@query("select concat('e', event_id) as id, json_extract_string(props, '$.k') as k, event_type as kind, 'parse' as step, '2024-01-01 00:00:00' as executed_at from events")
def s21_json(spark, d):
    """Properties and steps through the store and out as JSON, read back from that."""
    store = GraphStore.in_memory(spark)
    e = table(spark, d, "events")
    store.upsert_nodes(e.select(F.concat(F.lit("e"), "event_id").alias("id"), F.parse_json(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind")))).alias("properties")), NOW)
    step = F.expr("array(named_struct('transformer_name', 'parse', 'executed_at', timestamp_ntz'2024-01-01 00:00:00', 'duration', interval '1' second, 'metadata', map('k', 'v')))")
    store.upsert_edges(e.select(F.concat(F.lit("e"), "event_id").alias("from_node_id"), F.lit("x").alias("to_node_id"), F.lit("FeedsInto").alias("type"), step.alias("steps")), NOW)
    props = store.nodes().select("id", properties_json(F.col("properties")).alias("p"))
    steps = store.edges().select(F.col("from_node_id").alias("id"), steps_json(F.col("steps")).alias("s"))
    at = F.date_format(F.get_json_object("s", "$[0].executed_at").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    return props.join(steps, "id").select("id", F.get_json_object("p", "$.k").alias("k"), F.get_json_object("p", "$.kind").alias("kind"), F.get_json_object("s", "$[0].transformer_name").alias("step"), at.alias("executed_at"))


@query(bfs_sql("n.type <> 'Supplier'", "o1", 4, 1000))
def t10_dangling_edges(spark, d):
    """Edges to nodes that don't exist are passed over."""
    q = commerce(spark, d)
    return traversal.traverse(q.node_table.filter("type <> 'Supplier'"), q.edge_table, "o1", edge_type=None, max_depth=4, limit=1000)


@query(cte("user_times", "dated_handoff") + f""", n as (select id from user_times where valid_from <= timestamp '{AT}'),
  e as (select from_node_id as src, to_node_id as dst, seq from dated_handoff where valid_from <= timestamp '{AT}' and valid_to > timestamp '{AT}' and to_node_id in (select id from n)),
  s as (select min(src) as id from e where src in (select id from n)), w(id, depth, place) as (select id, 0, cast([] as bigint[]) from s union all select e.dst, depth + 1, list_append(place, e.seq) from w join e on e.src = w.id where depth < 3),
  b as (select *, row_number() over (partition by id order by depth, place) as rn from w)
  select cast(row_number() over (order by depth, place) - 1 as int) as position, id, depth from b where rn = 1""")
def t11_asof_traverse(spark, d):
    """Over what was valid at an instant, from the first node that has an edge then."""
    store = GraphStore.from_dataframes(spark, graph(spark, d, "user_times"), graph(spark, d, "dated_handoff"), NOW)
    then = store.as_of(AT)
    start = then.edge_table.join(then.node_table.select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi").agg(F.min("from_node_id")).first()[0]
    return then.start_from(start).traverse("FeedsInto", 3).execute()


@query(pagerank_sql(40).replace("round(rank, 6)", "round(rank, 4)"))
def a2_pagerank_converged(spark, d):
    """Until no rank changes by more than the tolerance; the SQL takes 40 steps, 0.85^40 of the first error."""
    return centrality.pagerank(graph(spark, d, "user_nodes"), graph(spark, d, "handoff")).select("id", F.round("rank", 4).alias("rank"))


@query(BETWEEN.format("and a.s in ('u1', 'u2', 'u3', 'u4', 'u5')"))
def a4_betweenness_joined(spark, d):
    """By joins alone, as graphs of any size are searched."""
    n = graph(spark, d, "user_nodes")
    return centrality.betweenness(n, graph(spark, d, "handoff_groups"), n.filter("id in ('u1', 'u2', 'u3', 'u4', 'u5')"), local=0).select("id", *r6("score"))


@query(CLOSE.format("s in ('u1', 'u2')"))
def a6_closeness_joined(spark, d):
    n = graph(spark, d, "user_nodes")
    return centrality.closeness(n, graph(spark, d, "handoff_groups"), n.filter("id in ('u1', 'u2')"), local=0).select("id", *r6("score"))


@query(ORACLES["a12_topological"])
def a12_topological_joined(spark, d):
    return connectivity.topological_order(graph(spark, d, "commerce_nodes"), graph(spark, d, "commerce_edges"), local_edges=0)


@query(cte("event_nodes", "event_edges") + ", p as (select concat('e', event_id) as id, row_number() over (partition by user_id order by ts, event_id) as n from events) select id, cast(n - 1 as int) as level, false as is_cyclic from p")
def a12_event_chains(spark, d):
    """A chain for each user, as long as the user has events, by joins alone."""
    return connectivity.topological_order(graph(spark, d, "event_nodes"), graph(spark, d, "event_edges"), local_edges=0)


@query(CYCLIC + " select id from bad")
def a13_cyclic_joined(spark, d):
    return connectivity.topological_order(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups"), local_edges=0).filter("is_cyclic").select("id")


@query(SCC)
def a15_scc_joined(spark, d):
    return connectivity.strong_components(graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups"), local_edges=0)


@query("select concat('u', user_id) as node_id, epoch_us(ts) as at, round(value, 6) as p99, round(greatest(least(1 - (0.35 * cast(event_type = 'error' as double) + 0.35 * least(value / 1000, 1)), 1), 0), 9) as health_score from events")
def h4_snapshots(spark, d):
    v = health.snapshot_vectors(metrics(spark, d))
    return v.select("node_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *r6("p99"), F.round("health_score", 9).alias("health_score"))


@query(VECTORS + " select node_id, 'RetryBudgetExhausted' as type, concat('Retry budget exhausted at ', node_id) as title, 1.0 as confidence, 'Warning' as severity from s where failure_prob > 0.2")
def h12_retry_insights(spark, d):
    """Nodes of which more than a fifth fails have used up their retries."""
    v = health.health_vectors(metrics(spark, d)).withColumn("retry_budget", F.when(F.col("failure_prob") > 0.2, 0).otherwise(F.col("retry_budget")))
    return health.retry_insights(v, NOW).select(F.get("related_node_ids", F.lit(0)).alias("node_id"), "type", "title", "confidence", "severity")


@query(ORACLES["a11_modularity"].replace(" select round(sum", ", q as (select sum").replace(", 6) as q from by_c, t", " as q from by_c, t)") + " select 'ClusterDiscovered' as type, concat('Cluster of ', count(*), ' nodes') as title, 'Info' as severity, any_value(round(q.q, 6)) as confidence, count(*) as n_nodes from m, q group by c")
def h13_cluster_insights(spark, d):
    e = graph(spark, d, "handoff")
    ends = e.select(F.col("from_node_id").alias("id")).union(e.select("to_node_id")).distinct()
    m = ends.select("id", (F.substring("id", 2, 9).cast("int") % 3).alias("community"))
    return health.cluster_insights(community.cluster_table(m, e), NOW).select("type", "title", "severity", *r6("confidence"), F.size("related_node_ids").cast("long").alias("n_nodes"))


@query(PREDICT.replace("150", "500") + f""", l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from r)
  select concat('u', user_id) as node_id, case when hot then 'BottleneckPrediction' else 'HealthDegradation' end as type, round(conf, 6) as confidence from l where rn = 1 and s < 0.7 and (hot or dh > 0.1)""")
def m3_agent(spark, d):
    """One round: nodes that stand as their last event left them, against the events before."""
    e = table(spark, d, "events").selectExpr("concat('u', user_id) as node_id", "ts", "event_id", "1 - least(value / 500, 1) as health_score", "value as predicted_latency_ms", "case when event_type = 'error' then 1D else 0D end as failure_prob")
    last = e.groupBy("node_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    marked = e.join(last, "node_id")
    now = marked.filter("event_id = last.event_id")
    store = GraphStore.in_memory(spark)
    store.upsert_nodes(now.select(F.col("node_id").alias("id"), F.lit("User").alias("type"), "health_score", "predicted_latency_ms", "failure_prob"), NOW)
    told = agent_round(store, marked.filter("event_id <> last.event_id").select("node_id", "ts", "health_score", "predicted_latency_ms", "failure_prob"), NOW)
    return told.select(F.get("related_node_ids", F.lit(0)).alias("node_id"), "type", *r6("confidence"))


@query(cte("user_nodes", "handoff_groups") + " select 'nodes.written' as name, cast(count(*) as double) as value from user_nodes union all select 'edges.written', count(*) from handoff_groups union all select 'edges.deleted', 1 union all select 'queries.executed', 2 union all select 'events.Write.nodes', 1")
def d1_engine_metrics(spark, d):
    store = GraphStore.from_dataframes(spark, graph(spark, d, "user_nodes"), graph(spark, d, "handoff_groups"), NOW)
    store.delete_edge(store.edges().agg(F.min("id")).first()[0], "2024-02-02 00:00:00")
    for q in (store.query().nodes("User"), store.query().limit(3)):
        q.execute()
    return store.metrics.table(spark).filter(F.col("name").isin("nodes.written", "edges.written", "edges.deleted", "queries.executed", "events.Write.nodes"))


HEADLINE = ("n7_order_limit", "n5_asof", "n10_edges_asof", "t2_traverse", "t1_shortest_path", "a1_degree", "a2_pagerank", "a3_betweenness", "a5_closeness", "a12_topological", "a12_event_chains", "a15_scc", "a16_wcc", "a17_hll", "h3_health_vectors", "h6_bottlenecks", "h16_decay", "s4_upsert")
