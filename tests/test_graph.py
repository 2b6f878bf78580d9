"""Small graphs with known answers, and every query against its SQL."""

from __future__ import annotations

import random
import time

import duckdb
import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from tempograph import queries
from tempograph.defaults import EngineConfig
from tempograph.diagnostics import Cancellation
from tempograph.functions import scores as S
from tempograph.operators import centrality, community, connectivity, health, traversal
from tempograph.operators.query import GraphQuery
from tempograph.plans.loop import shared_dir
from tempograph.sources.pipeline import PipelineMonitor, emit_edges, graph_sink, graph_source, sink_stream
from tempograph.sources.store import Drained, GraphStore
from tempograph.streaming.metrics import agent_round, agent_stream, apply_health, metrics_stream

SF = "/root/testdata/sf0.001"
NOW = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or str(x) in ("<NA>", "nan", "NaT"):
            return "-"
        return repr(float(x)) if isinstance(x, float) else str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def nodes(spark, **health_scores):
    return spark.createDataFrame([(i, "File", float(h)) for i, h in health_scores.items()], "id string, type string, health_score double")


def edges(spark, *pairs, weight=1.0, confidence=1.0, kind="DerivedFrom"):
    return spark.createDataFrame([(p[0], p[1], kind, weight, confidence, i) for i, p in enumerate(pairs)], "from_node_id string, to_node_id string, type string, weight double, confidence double, seq bigint")


def sets(df, by="component"):
    return sorted(sorted(r[0]) for r in df.groupBy(by).agg(F.collect_list("id")).select("collect_list(id)").collect())


def test_filters_join_from_the_left(spark):
    n = spark.createDataFrame([("n1", 0.9, 0.05), ("n2", 0.3, 0.05), ("n3", 0.9, 0.2), ("n4", float("nan"), 0.5)], "id string, health_score double, failure_prob double")
    q = GraphQuery(n, n)
    ids = lambda x: sorted(r.id for r in x.find_nodes().collect())
    assert ids(q.where("HealthScore", "LessThan", 0.5).or_().where("HealthScore", "GreaterThan", 0.8).where("FailureProb", "GreaterThan", 0.1)) == ["n3"]
    assert ids(q.where("HealthScore", "GreaterThan", 0.0)) == ["n1", "n2", "n3"]  # NaN is above nothing
    assert [r.id for r in q.where("FailureProb", "LessThan", 1).order_by("HealthScore").limit(2).find_nodes().collect()] == ["n2", "n1"]
    for bad in (lambda: q.limit(0), lambda: q.with_min_weight(2), lambda: q.nodes(""), lambda: q.where("HealthScore", "Near", 1), lambda: q.connected_via("Nope")):
        with pytest.raises(ValueError):
            bad()


def test_paths(spark):
    n, e = nodes(spark, A=1, B=0.05, C=1, D=1), edges(spark, "AB", "BC", "CD", "DX")
    path = lambda **k: [r.id for r in traversal.shortest_path(n, e, "A", k.pop("to", "C"), **k).orderBy("position").collect()]
    assert path() == ["A", "B", "C"] and path(to="A") == ["A"] and path(to="X") == [] and path(to="Z") == []
    assert path(predicate=F.col("health_score") > 0.1) == [] and path(to="D", max_depth=2) == [] and path(min_weight=1.0, min_confidence=1.0) == ["A", "B", "C"]
    assert traversal.shortest_path(n, edges(spark, "AB", weight=0.2), "A", "B", min_weight=0.5).count() == 0
    star = traversal.traverse(n, edges(spark, "AC", "AB", "AD", "BA"), "A", limit=3).collect()
    assert [(r.id, r.depth) for r in star] == [("A", 0), ("C", 1), ("B", 1)]
    skipped = traversal.traverse(n, edges(spark, "BC"), "B", predicate=F.col("health_score") > 0.5).collect()
    assert [(r.id, r.depth) for r in skipped] == [("C", 1)]


@pytest.mark.parametrize("local", [10, 0])
def test_cycles_and_components(spark, local):
    n = nodes(spark, A=1, B=1, C=1, D=1, E=1)
    e = edges(spark, "AB", "BC", "CA", "DC", "CE", "EE")
    assert sets(connectivity.strong_components(n, e, local)) == [["A", "B", "C"], ["D"], ["E"]]
    topo = {r.id: (r.level, r.is_cyclic) for r in connectivity.topological_order(n, e, local).collect()}
    assert topo == {"D": (0, False), **dict.fromkeys("ABCE", (None, True))}
    line = connectivity.topological_order(n, edges(spark, "AB", "BC"), local)
    assert {r.id: r.level for r in line.collect()} == {"A": 0, "B": 1, "C": 2, "D": 0, "E": 0}
    assert not connectivity.has_cycles(n, edges(spark, "AB", "BC"), local).first()[0]
    assert sets(connectivity.weak_components(n, edges(spark, "AB", "CD"))) == [["A", "B"], ["C", "D"], ["E"]]


def test_long_chain_is_sorted(spark):
    n = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("id"))
    e = spark.range(99_999).select(F.concat(F.lit("n"), "id").alias("from_node_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("to_node_id"))
    top = connectivity.topological_order(n, e).agg(F.max("level"), F.count("*"), F.count_if("is_cyclic")).first()
    assert tuple(top) == (99_999, 100_000, 0)


@pytest.mark.parametrize("local", [100, 0])
def test_centralities(spark, local):
    n = nodes(spark, A=1, B=1, C=1)
    between = {r.id: r.score for r in centrality.betweenness(n, edges(spark, "AB", "BC"), local=local).collect()}
    assert between == {"A": 0.0, "B": 1.0, "C": 0.0}
    ranks = {r.id: r.rank for r in centrality.pagerank(nodes(spark, A=1, B=1), edges(spark, "AB", "BA")).collect()}
    assert ranks["A"] == pytest.approx(ranks["B"]) == pytest.approx(0.5)
    close = {r.id: r.score for r in centrality.closeness(n, edges(spark, "AB", "BC"), local=local).collect()}
    assert close == {"A": pytest.approx(2 / 3), "B": 2.0, "C": 0.0}
    assert centrality.closeness(nodes(spark, A=1), edges(spark, "AB"), local=local).first().score == 1.0
    assert [r.id for r in centrality.by_degree(n, edges(spark, "BA", "BC")).collect()][0] == "B"


def test_local_and_joined_centralities_agree(spark):
    """Parallel edges, loops, edges to unknown nodes, chosen sources and none."""
    n = nodes(spark, A=1, B=1, C=1, D=1, E=1, F=1)
    e = edges(spark, "AB", "AB", "AC", "BD", "CD", "DE", "EA", "EE", "DX", "YA")
    some = n.filter("id in ('A', 'F')")
    table = lambda df: {r[0]: r[1] for r in df.collect()}
    for one in (lambda k: centrality.betweenness(n, e, some, k), lambda k: centrality.closeness(n, e, local=k)):
        assert table(one(100)) == pytest.approx(table(one(0)))
    assert centrality.closeness(n, e, n.limit(0)).isEmpty()
    assert set(table(centrality.betweenness(n, edges(spark, "XY"))).values()) == {0.0}


def test_communities(spark):
    n = nodes(spark, A=1, B=1, C=1, D=1, E=1, F=1)
    e = edges(spark, "AB", "BC", "CA", "DE", "EF", "FD", "CD")
    assert sets(community.clusters(n, e, mode="modularity"), "community") == [["A", "B", "C"], ["D", "E", "F"]]
    assert community.clusters(n, e).filter("community = id").count() == 6
    # A's loop gives it a gain: 1/6 - 2 * 2/36 > 0, so it goes where its first edge elsewhere leads.
    assert sets(community.clusters(n, edges(spark, "AA", "AC", "BD")), "community") == [["A", "C"], ["B"], ["D"], ["E"], ["F"]]


def test_scores(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    score = lambda f, lat, s: one(S.health_score(F.lit(f), F.lit(lat), F.lit(s)))
    assert score(0.0, 0.0, 0.0) == 1.0 and score(1.0, 2000.0, 1.0) == pytest.approx(0.0) and score(0.2, 500.0, 0.3) == pytest.approx(0.665)
    with pytest.raises(ValueError):
        S.health_score(F.lit(0.0), F.lit(0.0), F.lit(0.0), (0.5, 0.3, 0.1))
    assert one(S.time_to_impact_ms(F.lit(100.0), F.lit(100.0), F.lit(1.0))) == float("inf") and one(S.time_to_impact_ms(F.lit(600.0), F.lit(100.0), F.lit(10.0))) < 0
    old = F.lit("2023-12-02 00:00:00").cast("timestamp_ntz")
    assert one(S.decayed(F.lit(1.0), old, NOW, F.lit(0))) == pytest.approx(0.25) and one(S.decayed(F.lit(1.0), old, NOW, F.lit(100))) > 0.25


def test_store(spark):
    store = GraphStore.in_memory(spark, auto_classify=True)
    n = spark.createDataFrame([("n1", "old"), ("n2", "x")], "id string, label string").withColumn("properties", F.expr("""parse_json('{"hash": 1, "path": null}')"""))
    store.upsert_nodes(n, "2024-01-01 00:00:00")
    store.upsert_nodes(spark.createDataFrame([("n1", "new", 2)], "id string, label string, version int"), "2024-01-02 00:00:00")
    store.upsert_edges(spark.createDataFrame([("n1", "n2"), ("n2", "n1")], "from_node_id string, to_node_id string"), "2024-01-02 00:00:00")
    got = {r.id: (r.label, r.type, r.version) for r in store.nodes().collect()}
    assert got == {"n1": ("new", "Unknown", 3), "n2": ("x", "File", 2)}
    assert {r.label for r in store.at_transaction("2024-01-01 12:00:00")[0].collect()} == {"old", "x"}
    up = spark.createDataFrame([("n1", 0.1, 0.0, 900.0, 0.0, 999)], "id string, health_score double, failure_prob double, predicted_latency_ms double, resource_strain double, expected_version int")
    with pytest.raises(ValueError):
        store.update_node_health(up, NOW)
    store.update_node_health(up.withColumn("expected_version", F.lit(3)), NOW)
    assert [r.id for r in store.degraded_nodes().collect()] == ["n1"]
    again = GraphStore.open(spark, store.path)
    assert again.nodes().count() == 2 and again.open_nodes().count() == 2 and again.compact().edges().count() == 2
    history = spark.createDataFrame([("n1", "2024-01-30 00:00:00", 1.0, 100.0)], "node_id string, ts string, health_score double, predicted_latency_ms double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    told = agent_round(store, history, NOW).collect()
    assert [(r.type, r.severity, list(r.related_node_ids)) for r in told] == [("BottleneckPrediction", "Critical", ["n1"])] and store.insights("BottleneckPrediction").count() == 1
    edge = store.edges().filter("from_node_id = 'n1'").first().id
    store.delete_edge(edge, NOW)
    assert store.edges().count() == 1
    store.delete_nodes(store.node("n2"), NOW)
    assert store.edges().count() == 0 and store.nodes().count() == 1
    store.drain()
    with pytest.raises(Drained):
        store.upsert_nodes(n, NOW)
    assert health.store_health(store.state) == "Healthy" and health.store_health("Draining") == "Degraded"


def test_pipeline_ends(spark):
    store = GraphStore.in_memory(spark)
    results = spark.createDataFrame([(True, ("e1", "doc.pdf")), (False, None), (False, ("e2", "x"))], "is_success boolean, value struct<id:string,name:string>")
    graph_sink(results, store, {"id": F.col("value.id"), "label": F.col("value.name"), "type": F.lit("File")}, NOW)
    assert [(r.id, r.label) for r in graph_source(store, "File").collect()] == [("e1", "doc.pdf")]
    back = emit_edges(spark.createDataFrame([("e1", "e9")], "a string, b string"), store, {"from_node_id": F.col("a"), "to_node_id": F.col("b"), "type": F.lit("FeedsInto")}, NOW)
    assert back.count() == 1 and store.query().find_edges("FeedsInto").count() == 1
    vectors = spark.createDataFrame([("e1", 0.5, 0.0, 1.0, 0.0), ("nobody", 0.5, 0.0, 1.0, 0.0)], "node_id string, health_score double, failure_prob double, predicted_latency_ms double, resource_strain double")
    apply_health(store, vectors, NOW)
    assert store.nodes().first().health_score == 0.5


def test_consolidation(spark):
    make = lambda ids, c: spark.createDataFrame([(i, "T", "t", "d", ["n1"], c, "Info", NOW) for i in ids], "id string, type string, title string, description string, related_node_ids array<string>, confidence double, severity string, generated_at string").withColumn("generated_at", F.col("generated_at").cast("timestamp_ntz"))
    out = health.consolidate(make(["new"], 0.8), make("abcde", 0.7)).first()
    assert out.id == "consolidated_new" and out.confidence == pytest.approx((5 * 0.7 + 0.8) / 6 + 0.1)
    assert health.consolidate(make(["new"], 0.8), make("a", 0.7)).first().id == "new"
    assert health.consolidate_all(make("abcdef", 0.5)).count() == 1


@pytest.mark.parametrize("local", [0, 3, 1000])
def test_levels_by_tables_and_in_one_task(spark, local):
    """A graph that splits into nodes without edges, levels, and a cycle with what lies after it."""
    n, e = nodes(spark, **dict.fromkeys("ABCDEFGHZ", 1.0)), edges(spark, "AB", "BC", "AC", "CD", "BD", "EF", "FE", "FG", "GH", "AB")
    got = {r.id: (r.level, r.is_cyclic) for r in connectivity.topological_order(n, e, local).collect()}
    assert got == {"A": (0, False), "B": (1, False), "C": (2, False), "D": (3, False), "Z": (0, False), **{x: (None, True) for x in "EFGH"}}
    assert {r.id: r.component for r in connectivity.strong_components(n, e, local).collect()} == {**{x: x for x in "ABCDGHZ"}, "E": "E", "F": "E"}


def test_consolidate_takes_the_whole_table(spark, duck):
    e = duck.sql(f"select event_id, user_id, {queries.KIND}, value, epoch_us(ts) from events").fetchall()
    first, last = min(r[4] for r in e), max(r[4] for r in e)
    start = last - (last - first) // 8
    i = [(f"i{n}", kind, [f"u{u}", f"u{u + 1}"], v / 1000, t >= start) for n, u, kind, v, t in e]
    want = []
    for key, kind, nodes, c, late in i:
        if late:
            near = [o for o in i if not o[4] and o[1] == kind and set(o[2]) & set(nodes)]
            k, many = len(near) + 1, len(near) + 1 >= 5
            value = min((c + sum(o[3] for o in near)) / k + 0.1 * (k - 5), 1) if many else c
            want.append((f"consolidated_{key}" if many else key, kind, pytest.approx(value, abs=1e-6), ",".join(sorted({*nodes, *(x for o in near for x in o[2])}) if many else nodes)))
    got = sorted(map(tuple, queries.QUERIES["h14_consolidate"](spark, SF).collect()))
    assert got == sorted(want, key=lambda r: r[0]) and len(got) > 5
    assert any(r[0].startswith("consolidated_") for r in got)


def test_levels_of_many_shapes(spark):
    """Random graphs with chains, trees, rings, parallel edges and loops: joins alone, a few edges in a task, and all in one
    tell the same levels as peeling by hand."""
    r = random.Random(7)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(70)] + [(f"t{i // 2}", f"t{i}") for i in range(1, 60)] + [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r2", "q1"), ("q1", "q2"), ("q2", "c40"), ("z", "z"), ("z", "y")]
    pairs += [(f"c{i}", f"t{i}") for i in range(0, 60, 7)] + [tuple(sorted((f"x{r.randrange(30):02}", f"x{r.randrange(30):02}"))) for _ in range(45)] + [("c3", "c4"), ("t4", "x15"), ("c69", "x01")]
    pairs = [p for p in pairs if p[0] != p[1] or p[0] == "z"]
    ids = sorted({x for p in pairs for x in p} | {"alone"})
    n, e = nodes(spark, **dict.fromkeys(ids, 1.0)), edges(spark, *pairs)
    left, level = set(pairs), {}
    live = set(ids)
    while True:
        ready = {x for x in live if not any(b == x for _, b in left)}
        if not ready:
            break
        for x in ready:
            level[x] = max([level[a] + 1 for a, b in pairs if b == x], default=0)
        live -= ready
        left = {p for p in left if p[0] not in ready}
    want = {x: (level.get(x), x not in level) for x in ids}
    for local in (0, 40, 10_000):
        got = {r.id: (r.level, r.is_cyclic) for r in connectivity.topological_order(n, e, local).collect()}
        assert got == want, local


def test_greedy_groups_follow_the_order(spark):
    r = random.Random(3)
    rows = [(f"i{k}", r.choice("AB"), [f"n{r.randrange(40)}" for _ in range(r.randrange(4))], f"2024-01-01 00:{r.randrange(20):02}:00") for k in range(120)]
    leaders, want = [], {}
    for i, kind, own, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        first = next((j for j, k, nodes_ in leaders if k == kind and set(own) & set(nodes_)), None)
        if first is None:
            leaders.append((i, kind, own))
        want[i] = first or i
    df = spark.createDataFrame(rows, "id string, type string, related_node_ids array<string>, at string").selectExpr("*", "cast(at as timestamp_ntz) as generated_at")
    assert {x.id: x.leader for x in health.group_greedily(df).collect()} == want and len(set(want.values())) > 20
    assert health.group_greedily(df.limit(0)).count() == 0


def test_equal_keys_of_one_batch(spark):
    """The last row of a key wins, though the batch is spread over partitions."""
    store = GraphStore.in_memory(spark)
    n = spark.createDataFrame([(f"n{i % 50}", f"{i:04}") for i in range(2000)], "id string, label string").repartitionByRange(7, "label")
    store.upsert_nodes(n, NOW)
    assert {r.id: r.label for r in store.nodes().collect()} == {f"n{i % 50}": f"{i:04}" for i in range(2000)}
    e = spark.createDataFrame([("a", f"b{i % 5}", i / 100) for i in range(100)], "from_node_id string, to_node_id string, weight double").repartitionByRange(7, "weight")
    store.upsert_edges(e, NOW)
    assert {r.to_node_id: r.weight for r in store.edges().collect()} == {f"b{i % 5}": i / 100 for i in range(100)}
    with pytest.raises(ValueError):
        store.insert_insights(spark.createDataFrame([("i", "Odd", "t", "d", ["n"], 1.0, "Info", NOW)], "id string, type string, title string, description string, related_node_ids array<string>, confidence double, severity string, generated_at string"))


def test_cancelling(spark):
    token, failed = Cancellation(spark), []

    def work():
        try:
            with token:
                spark.range(4).repartition(2).mapInPandas(lambda b: (time.sleep(30), *b)[1:], "id long").count()
        except Exception as e:
            failed.append(e)

    t = InheritableThread(target=work)
    t.start()
    time.sleep(4)
    token.cancel()
    t.join(25)
    assert failed and not t.is_alive()
    with pytest.raises(RuntimeError), token:
        pass


def test_monitor_minds_its_own_query(spark, tmp_path):
    """Another query's end doesn't drain the store; a failing one faults it."""
    import pandas as pd

    for i in range(3):
        pd.DataFrame({"is_success": [True, False], "id": [f"a{i}", f"b{i}"]}).to_parquet(tmp_path / f"{i}.parquet")
    stream = lambda: spark.readStream.schema("is_success boolean, id string").parquet(str(tmp_path)).selectExpr("is_success", "named_struct('id', id) as value")
    store, other = GraphStore.in_memory(spark), GraphStore.in_memory(spark)
    monitor = PipelineMonitor(store, "files", "nodes", lambda: NOW)
    to_node = {"id": F.col("value.id")}
    spark.streams.addListener(monitor)
    sink_stream(stream(), other, to_node, lambda: NOW, shared_dir(spark, "c")).awaitTermination()
    spark.streams.removeListener(monitor)
    assert store.state == "Running" and not monitor.entries
    monitor = PipelineMonitor(store, "files", "nodes", lambda: NOW)
    q = monitor.watch(lambda: sink_stream(stream().selectExpr("is_success", "named_struct('id', raise_error('x')) as value"), store, {"id": F.col("value.id").cast("string")}, lambda: NOW, shared_dir(spark, "c")))
    monitor.finish(q)
    assert store.state == "Faulted" and monitor.error


def test_metrics_wait_for_their_trigger(spark, tmp_path):
    import pandas as pd

    for i in range(5):
        spark.createDataFrame(pd.DataFrame({"node_id": ["n1"], "x": [float(i)]})).selectExpr("node_id", f"timestamp_ntz'2024-01-01 00:00:0{i}' as ts", "map('AvgLatencyMs', x) as values").write.mode("append").parquet(str(tmp_path / "m"))
    sizes = []
    stream = metrics_stream(spark, str(tmp_path / "m"), EngineConfig(metrics_files_per_trigger=2))
    stream.writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 5 and max(sizes) <= 2


def test_agent_stream(spark, tmp_path):
    store = GraphStore.in_memory(spark)
    store.upsert_nodes(spark.createDataFrame([("n1", 0.1, 900.0)], "id string, health_score double, predicted_latency_ms double"), NOW)
    history = spark.createDataFrame([("n1", "2024-01-30 00:00:00", 1.0, 100.0)], "node_id string, ts string, health_score double, predicted_latency_ms double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spark.range(1).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "ticks"))
    q = agent_stream(store, ticks, history, lambda: NOW, str(tmp_path / "c"))
    until = time.time() + 25
    while time.time() < until and store.insights().isEmpty():
        time.sleep(0.5)
    q.stop()
    assert {r.type for r in store.insights().collect()} == {"BottleneckPrediction"}
