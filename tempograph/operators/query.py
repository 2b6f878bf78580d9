"""An immutable fluent builder whose terminals give one DataFrame each."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults as D
from ..diagnostics import EngineMetrics
from ..functions.filters import OPERATORS, Both, Either, PropertyFilter
from ..functions.temporal import as_of, between
from ..schema import EDGE_TYPES
from . import traversal


def _share(name: str, x: float) -> float:
    if not 0 <= x <= 1:
        raise ValueError(f"{name} must be from 0 to 1")
    return float(x)


def _positive(name: str, n: int) -> int:
    if n <= 0:
        raise ValueError(f"{name} must be positive")
    return n


def _given(name: str, x):
    if x is None or x == "":
        raise ValueError(f"{name} must be given")
    return x


@dataclass(frozen=True)
class GraphQuery:
    """Every step returns a new query, so queries can be shared. Nothing runs before an action on a terminal's result."""

    node_table: DataFrame
    edge_table: DataFrame
    node_type: str | None = None
    filter: PropertyFilter | Both | Either | None = None
    either_next: bool = False
    at: datetime | str | None = None
    span: tuple | None = None
    order: tuple[str, bool] | None = None
    n: int | None = None
    start: str | None = None
    target: str | None = None
    edge_type: str = D.EDGE_TYPE
    depth: int | None = None
    predicate: Column | None = None
    min_weight: float | None = None
    min_confidence: float | None = None
    insight_table: DataFrame | None = None
    insight_type: str | None = None
    metrics: EngineMetrics | None = None

    def nodes(self, node_type: str) -> GraphQuery:
        return replace(self, node_type=_given("node type", node_type))

    def where(self, name: str, operator: str, value: float) -> GraphQuery:
        """Joins a condition to those before: by and, or by or right after or_(). No precedence."""
        if operator not in OPERATORS:
            raise ValueError(f"operator must be one of {OPERATORS}")
        new = PropertyFilter(_given("property", name), operator, value)
        if self.filter is not None:
            new = (Either if self.either_next else Both)(self.filter, new)
        return replace(self, filter=new, either_next=False)

    def and_(self) -> GraphQuery:
        return replace(self, either_next=False)

    def or_(self) -> GraphQuery:
        return replace(self, either_next=True)

    def as_of(self, at: datetime | str) -> GraphQuery:
        return replace(self, at=_given("instant", at))

    def between(self, start: datetime | str, end: datetime | str) -> GraphQuery:
        return replace(self, span=(_given("start", start), _given("end", end)))

    def order_by(self, name: str, descending: bool = False) -> GraphQuery:
        return replace(self, order=(_given("property", name), descending))

    def limit(self, n: int) -> GraphQuery:
        return replace(self, n=_positive("limit", n))

    def connected_via(self, edge_type: str) -> GraphQuery:
        if edge_type not in EDGE_TYPES:
            raise ValueError(f"edge type must be one of {EDGE_TYPES}")
        return replace(self, edge_type=edge_type)

    def start_from(self, node_id: str) -> GraphQuery:
        return replace(self, start=_given("start", node_id))

    def to(self, node_id: str) -> GraphQuery:
        return replace(self, target=_given("target", node_id))

    def shortest_path(self, start: str, target: str, edge_type: str = D.EDGE_TYPE) -> GraphQuery:
        return self.start_from(start).to(target).connected_via(edge_type)

    def traverse(self, edge_type: str = D.EDGE_TYPE, depth: int = D.TRAVERSE_DEPTH) -> GraphQuery:
        return self.connected_via(edge_type).max_depth(depth)

    def max_depth(self, n: int) -> GraphQuery:
        return replace(self, depth=_positive("depth", n))

    def where_node(self, predicate: Column | str) -> GraphQuery:
        return replace(self, predicate=F.expr(predicate) if isinstance(predicate, str) else predicate)

    def with_min_weight(self, w: float) -> GraphQuery:
        return replace(self, min_weight=_share("weight", w))

    def with_min_confidence(self, c: float) -> GraphQuery:
        return replace(self, min_confidence=_share("confidence", c))

    @property
    def kind(self) -> str:
        return "FindInsights" if self.insight_type else "FindPath" if self.start and self.target else "Traverse" if self.start else "FindNodes"

    def insights(self, insight_type: str) -> GraphQuery:
        return replace(self, insight_type=_given("insight type", insight_type))

    def find_nodes(self) -> DataFrame:
        """Type, filters, time, order, limit. Unordered limits go by id, so that they give the same rows each time."""
        out = self.node_table
        if self.node_type:
            out = out.filter(F.col("type") == self.node_type)
        if self.filter:
            out = out.filter(self.filter.column())
        if self.at is not None:
            out = out.filter(as_of(self.at))
        if self.span:
            out = out.filter(between(*self.span))
        if self.order:
            key = F.col("valid_from" if self.order[0] == "CreatedAt" else "health_score")
            out = out.orderBy(key.desc() if self.order[1] else key.asc(), "id")
        elif self.n:
            out = out.orderBy("id")
        return out.limit(self.n) if self.n else out

    def find_edges(self, edge_type: str | None = None) -> DataFrame:
        """Edges of a type, valid at the instant if one is set (valid_to excluded)."""
        out = self.edge_table if edge_type is None else self.edge_table.filter(F.col("type") == edge_type)
        return out if self.at is None else out.filter(as_of(self.at, closed=False))

    def _walk(self) -> dict:
        return {"edge_type": self.edge_type, "predicate": self.predicate, "min_weight": self.min_weight, "min_confidence": self.min_confidence}

    def find_path(self) -> DataFrame:
        if self.kind != "FindPath":
            raise ValueError("a path needs a start and a target")
        return traversal.shortest_path(self.node_table, self.edge_table, self.start, self.target, max_depth=self.depth or D.PATH_DEPTH, **self._walk())

    def find_reached(self) -> DataFrame:
        if not self.start:
            raise ValueError("a traversal needs a start")
        return traversal.traverse(self.node_table, self.edge_table, self.start, max_depth=self.depth or D.TRAVERSE_DEPTH, limit=self.n or D.TRAVERSE_LIMIT, **self._walk())

    def find_insights(self) -> DataFrame:
        """Insights, of the type if one is set, oldest first where a limit is set."""
        if self.insight_table is None:
            raise ValueError("this query has no table of insights")
        out = self.insight_table
        if self.insight_type:
            out = out.filter(F.col("type") == self.insight_type)
        return out.orderBy("generated_at", "id").limit(self.n) if self.n else out

    def execute(self) -> DataFrame:
        run = {"FindPath": self.find_path, "Traverse": self.find_reached, "FindNodes": self.find_nodes, "FindInsights": self.find_insights}[self.kind]
        if self.metrics is None:
            return run()
        self.metrics.add("queries.executed")
        with self.metrics.span(self.node_table.sparkSession, f"Query.{self.kind}"):
            return run()
