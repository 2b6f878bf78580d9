"""Components, topological order and cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..plans.loop import Rounds, drop_dir, stored_seen


def _starred(pairs: DataFrame, large: bool) -> DataFrame:
    """Every u's partners are hung on the least of them. Large star: partners above u; small star: those below, and u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return pairs.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", name: str = "components") -> DataFrame:
    """(id, component) for every end of an edge that isn't a loop; component is the least id that it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): only joins and aggregates, a number of rounds that
    grows with the logarithm of the nodes. A hub's partners are spread by partial aggregation and skew joins. Each round
    is written to the shared folder. Null ends and loops are ignored; no edges, no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    prints = {"n": F.count("*"), "x": F.expr("bit_xor(xxhash64(u, v))")}
    now, path, seen = stored_seen(pairs, name, **prints)
    while seen["n"]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, True).distinct()
        small = _starred(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).distinct()
        was = seen
        then, new_path, seen = stored_seen(small, name, **prints)
        drop_dir(spark, path)
        now, path = then, new_path
        if was == seen:
            break
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionAll(ends.select(F.col("component").alias("id"), "component").distinct())


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes; those without edges are their own."""
    known = known_edges(nodes, edges)
    found = connected_components(known, "src", "dst", "wcc")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) of the edges between nodes that exist, parallel ones kept."""
    ids = nodes.select("id")
    e = edges.select(F.col("from_node_id").alias("src"), F.col("to_node_id").alias("dst"))
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _one_task(e: DataFrame, solve, schema: str) -> DataFrame:
    """Edges that are counted and few, solved in one task: their depth then costs no jobs. Nodes without edges stay out, as
    nobody counted them."""
    return e.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda rows: solve(rows.drop(columns="g")), schema)


def _hung(e: DataFrame, at: DataFrame, rounds: Rounds) -> DataFrame | None:
    """(id, head, d, c) of the nodes with one edge in: their level is the greater of c and their head's level and d. A head
    has no edge in, or several. Pointers are doubled, so a chain of n nodes takes log n steps; nodes that come to no head
    (they lie on a ring of such nodes or after one) are left out. None if there are no such nodes."""
    one = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.first("src").alias("p"), F.first("w").alias("d")).filter("n = 1")
    now, n = rounds.counted(one.join(at, "id", "left").select("id", "p", "d", F.col("at").alias("c"), F.lit(False).alias("done")))
    if not n:
        return None
    for _ in range(n.bit_length() + 1):
        up = now.select(F.col("id").alias("p"), F.col("p").alias("pp"), F.col("d").alias("pd"), F.col("c").alias("pc"))
        j = now.join(up, "p", "left")
        then = j.select("id", F.coalesce("pp", "p").alias("p"), (F.col("d") + F.coalesce("pd", F.lit(0))).alias("d"), F.greatest("c", F.col("pc") + F.col("d")).alias("c"), F.col("pp").isNull().alias("done"))
        now, open_rows = rounds.counted_where(then, ~F.col("done"), now)
        if not open_rows:
            break
    return now.filter("done").select("id", F.col("p").alias("head"), "d", "c")


def topological_order(nodes: DataFrame, edges: DataFrame, local_edges: int = D.LOCAL_EDGES) -> DataFrame:
    """(id, level, is_cyclic): level is the longest path to a node from one without predecessors; nodes on a cycle or after
    one have none and are cyclic. Ordered by (level, id), the others are a topological order.

    Rounds of joins on edges (src, dst, w), w being the steps that an edge stands for. First all nodes with one edge in are
    hung on the node above them that has none or several, and their edges out start there: chains and trees of any depth
    go in a number of steps that grows with its logarithm. Then nodes without edge in get their level and go. Every round
    leaves fewer edges; as soon as few are left, one task peels them, so that depth costs no more jobs. What no round
    changes is on cycles or after them.
    """
    rounds = Rounds(nodes.sparkSession, "topo")
    e, n = rounds.counted(known_edges(nodes, edges).distinct().withColumn("w", F.lit(1)))
    at = rounds.cut(e.limit(0).select(F.col("src").alias("id"), F.col("w").alias("at")))
    hung: list[DataFrame] = []
    was = -1
    best = lambda t: t.groupBy("id").agg(F.max("at").alias("at"))
    while n > local_edges and n != was:
        was = n
        found = _hung(e, at, rounds)
        if found is not None:
            found = rounds.cut(found)
            hung.append(found)
            kept = e.join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
            moved = kept.join(found.select(F.col("id").alias("src"), "head", "d", "c"), "src", "left")
            moved = rounds.cut(moved.select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("d", F.lit(0))).alias("w"), (F.col("c") + F.col("w")).alias("at")))
            at = rounds.cut(best(at.unionAll(moved.filter("at is not null").select(F.col("dst").alias("id"), "at"))), at)
            e, n = rounds.counted(moved.groupBy("src", "dst").agg(F.max("w").alias("w")), e, moved)
        if n:
            deeper = e.select(F.col("dst").alias("src")).distinct()
            ready = e.join(deeper, "src", "left_anti").join(at.withColumnRenamed("id", "src"), "src", "left").select(F.col("dst").alias("id"), (F.col("w") + F.coalesce("at", F.lit(0))).alias("at"))
            then = rounds.cut(best(at.unionAll(ready)))
            e, n = rounds.counted(e.join(deeper, "src", "left_semi"), e)
            at = rounds.cut(then, at, then)
    if n and n <= local_edges:
        rows = e.unionAll(at.select("id", F.lit(None).cast("string"), "at"))
        rest = rounds.cut(_one_task(rows, _peel, "id string, at int, is_cyclic boolean"))
    else:  # all that is left is on cycles or after them
        rest = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().select("id", F.lit(None).cast("int").alias("at"), F.lit(True).alias("is_cyclic"))
    later = at.join(rest.select("id"), "id", "left_anti").select("id", "at", F.lit(False).alias("is_cyclic")).unionAll(rest)
    for h in reversed(hung):
        up = later.select(F.col("id").alias("head"), F.col("at").alias("up"), "is_cyclic")
        own = h.join(up, "head", "left").select("id", F.greatest("c", F.coalesce("up", F.lit(0)) + F.col("d")).alias("at"), F.coalesce("is_cyclic", F.lit(False)).alias("is_cyclic"))
        later = rounds.cut(later.join(h.select("id"), "id", "left_anti").unionAll(own))
    cyclic = F.coalesce("is_cyclic", F.lit(False))
    return nodes.select("id").distinct().join(later, "id", "left").select("id", F.when(~cyclic, F.coalesce("at", F.lit(0))).alias("level"), cyclic.alias("is_cyclic"))


def _peel(rows: pd.DataFrame) -> pd.DataFrame:
    """Levels of one task: rows without dst tell what level a node has at least."""
    is_edge = rows["dst"].notna()
    e, least = rows[is_edge], rows[~is_edge]
    codes, ids = pd.factorize(pd.concat([e["src"], e["dst"]]))
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    degree = [0] * len(ids)
    for a, b, w in zip(codes[: len(e)].tolist(), codes[len(e) :].tolist(), e["w"].tolist(), strict=True):
        out[a].append((b, w))
        degree[b] += 1
    known = dict(zip(least["src"], least["w"], strict=True))
    level = [int(known.get(i, 0)) for i in ids]
    now, done = [i for i, d in enumerate(degree) if not d], 0
    while now:
        a = now.pop()
        done += 1
        for b, w in out[a]:
            level[b] = max(level[b], level[a] + w)
            degree[b] -= 1
            if not degree[b]:
                now.append(b)
    cyclic = [d > 0 for d in degree]
    return pd.DataFrame({"id": ids, "at": pd.array([None if c else x for x, c in zip(level, cyclic, strict=True)], dtype="Int32"), "is_cyclic": cyclic})


def has_cycles(nodes: DataFrame, edges: DataFrame, local_edges: int = D.LOCAL_EDGES) -> DataFrame:
    """One row: has_cycles."""
    return topological_order(nodes, edges, local_edges).agg(F.coalesce(F.bool_or("is_cyclic"), F.lit(False)).alias("has_cycles"))


def strong_components(nodes: DataFrame, edges: DataFrame, local_edges: int = D.LOCAL_EDGES) -> DataFrame:
    """(id, component), component being its least id.

    Small graphs take one task. Larger ones are coloured: nodes without way in or out go first, as components of their own;
    each other takes the least id that reaches it as its colour; what reaches a colour's own node within the colour is a
    component; and so on with the rest.
    """
    rounds = Rounds(nodes.sparkSession, "scc")
    e, n = rounds.counted(known_edges(nodes, edges).filter("src <> dst").distinct())
    if n <= local_edges:
        found = _one_task(e, _strong, "id string, component string")
        return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    done = rounds.cut(nodes.select("id").distinct().limit(0).withColumn("component", F.col("id")))
    left, n_left = rounds.counted(nodes.select("id").distinct())
    while n_left:
        both = rounds.cut(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"), e)
        e = both
        inner = left.join(both.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(both.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        single, n_single = rounds.counted(left.join(inner, "id", "left_anti"))
        if n_single:
            done = done.unionAll(single.select("id", F.col("id").alias("component")))
            left, n_left = rounds.counted(left.join(single, "id", "left_anti"), left)
            continue
        rounds.drop(single)
        colour = rounds.cut(left.select("id", F.col("id").alias("c")))
        moved = True
        while moved:
            into = both.join(colour, both["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("least"))
            then = colour.join(into, "id", "left").select("id", F.least("c", "least").alias("c"), (F.col("least") < F.col("c")).alias("moved"))
            then, moved = rounds.counted_where(then, F.coalesce("moved", F.lit(False)), colour)
            colour = then
        same = both.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
        same = rounds.cut(same)
        new, n_new = rounds.counted(colour.filter("id = c").select("id", "c"))
        found = new
        while n_new:
            back = same.join(new.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            new, n_new = rounds.counted(back.join(found, "id", "left_anti").select("id", "c"))
            found = found.unionAll(new)
        found = rounds.cut(found, colour, same)
        done = done.unionAll(found.select("id", F.col("c").alias("component")))
        left, n_left = rounds.counted(left.join(found, "id", "left_anti"), left)
    return done


def _strong(rows: pd.DataFrame) -> pd.DataFrame:
    """By forward reach in finishing order, then backward (Kosaraju), without recursion."""
    ids = sorted({*rows["src"], *rows["dst"]})
    out: dict[str, list[str]] = {i: [] for i in ids}
    into: dict[str, list[str]] = {i: [] for i in ids}
    for a, b in zip(rows["src"], rows["dst"], strict=True):
        out[a].append(b)
        into[b].append(a)
    order, seen = [], set()
    for i in ids:
        stack = [] if i in seen else [(i, iter(out[i]))]
        seen.add(i)
        while stack:
            x, rest = stack[-1]
            y = next((y for y in rest if y not in seen), None)
            if y is None:
                order.append(x)
                stack.pop()
            else:
                seen.add(y)
                stack.append((y, iter(out[y])))
    component: dict[str, str] = {}
    for i in reversed(order):
        if i in component:
            continue
        group, stack = [], [i]
        component[i] = i
        while stack:
            x = stack.pop()
            group.append(x)
            for y in into[x]:
                if y not in component:
                    component[y] = i
                    stack.append(y)
        least = min(group)
        for x in group:
            component[x] = least
    return pd.DataFrame({"id": ids, "component": [component[i] for i in ids]})
