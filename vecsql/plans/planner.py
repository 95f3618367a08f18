"""Joins with one distance predicate, ordered by what the predicate really leaves.

A query is described by its relations, join keys, filters and the vector predicate. When it
joins more than two relations, the rows of the vector side are counted (``mode='probe'``) or
estimated from a sample (``'sample'``), the others are guessed from their sizes, and a left-deep order
grows along the join keys, from the relation that makes it cheapest. The distance is computed once, in the vector
side, and carried on. The vector side is broadcast only if its counted rows are few. With a catalog of indexes, an
index that serves the predicate is counted and read instead of the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vecsql.functions.distance import METRICS, distance, scan
from vecsql.operators.index import Catalog

from .estimate import States, observed, probe, q_error, sampled, setting

#: A counted side is broadcast up to so many bytes (64 for each column of each row).
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class VectorPredicate:
    """table and key: what an index of the column was made from, if one may be used. k: only so many nearest rows, instead of a radius."""

    relation: str
    column: str
    query: tuple[float, ...]
    radius: float | None
    function: str = "array_distance"
    compare: str = "<"
    table: str | None = None
    key: str | None = None
    k: int | None = None

    def condition(self, dist):
        ops = {"<": dist < self.radius, "<=": dist <= self.radius, ">": dist > self.radius, ">=": dist >= self.radius}
        return ops[self.compare]


@dataclass(frozen=True)
class Join:
    """Keys are pairs of columns, of the first and of the second relation; kind is 'inner' or 'left'."""

    left: str
    right: str
    keys: tuple[tuple[str, str], ...]
    kind: str = "inner"


@dataclass
class VectorQuery:
    relations: dict[str, DataFrame]
    joins: Sequence[Join]
    predicate: VectorPredicate | None
    filters: dict[str, str] = field(default_factory=dict)
    residual: Sequence[str] = ()
    columns: dict[str, Sequence[str]] = field(default_factory=dict)
    keep_vector: bool = False

    def is_vector_query(self) -> bool:
        """Whether there is an order to choose: more than two relations and a range predicate on a vector."""
        return len(self.relations) > 2 and self.predicate is not None


@dataclass
class Plan:
    """``frame`` is the joined query. Rows that were kept for it stay until ``release``."""

    frame: DataFrame
    order: list[str]
    estimates: dict[str, float]
    vector_rows: float | None
    broadcast: bool
    index: str | None = None
    kept: DataFrame | None = None
    seen: Observation | None = None
    teach: tuple[States, VectorQuery, float] | None = None
    vector: str | None = None

    def explain(self) -> str:
        lines = []
        for name in self.order:
            how = [t for t, yes in (("vector side", name in self._vector), (f"index {self.index}", name in self._vector and self.index), ("broadcast", name in self._vector and self.broadcast)) if yes]
            lines.append(f"{name}: about {self.estimates[name]:.0f} rows" + (f" ({', '.join(how)})" if how else ""))
        return "\n".join(lines)

    @property
    def _vector(self) -> tuple[str, ...]:
        return (self.vector,) if self.vector else ()

    def learn(self) -> float | None:
        """After an action on the frame: the error of the estimate, from the rows that the vector side really had, noted for next time."""
        if self.seen is None or self.teach is None:
            return None
        states, query, table_rows = self.teach
        return feedback(states, query, self.vector_rows or 1.0, float(self.seen.get["rows"]), table_rows)

    def collect(self) -> list:
        """All rows; the estimate is learned from on the way."""
        rows = self.frame.collect()
        self.learn()
        return rows

    def release(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()


def _guess(df: DataFrame, condition: str | None) -> float:
    """Rows from the size of the scan and usual selectivities: a tenth for an equality, a third for anything else."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = float(stats.sizeInBytes()) / (8 * max(1, len(df.columns)))
    for part in re.split(r"(?i)\band\b", condition or ""):
        if part.strip():
            rows *= 0.1 if re.search(r"(?<![<>!])=|(?i:\bin\b)", part) else 1 / 3
    return max(rows, 1.0)


def plan(
    query: VectorQuery,
    mode: str = "probe",
    states: States | None = None,
    dist: str = "dist",
    broadcast_bytes: int = BROADCAST_BYTES,
    catalog: Catalog | None = None,
    index: str | None = None,
) -> Plan:
    """mode: 'probe' counts the vector side, 'sample' estimates it and learns (see ``Plan.learn``), 'off' joins in the order given.

    catalog: its index of the predicate's table and column, or the one that ``index`` names, is read instead of the
    table's vectors, in any mode.
    """
    sides: dict[str, DataFrame] = {}
    estimates: dict[str, float] = {}
    p, vector_rows, few, used = query.predicate, None, False, None
    kept = seen = teach = None
    for name, df in query.relations.items():
        side = df.alias(name).filter(query.filters[name]) if name in query.filters else df
        if p is not None and name == p.relation:
            used = _index_of(p, catalog, index)
            side = _by_index(side, p, catalog, used, dist, query.keep_vector) if used else _by_scan(side, p, dist, query.keep_vector)
        if name in query.columns:
            extra = [dist] if p is not None and name == p.relation else []
            side = side.select(*query.columns[name], *extra)
        sides[name] = side
    if query.is_vector_query() and mode != "off":
        name = p.relation
        base = query.relations[name]
        filtered = base.alias(name).filter(query.filters[name]) if name in query.filters else base
        if mode == "probe":
            sides[name], n = probe(sides[name])
            kept, vector_rows = sides[name], float(n)
            few = n * 64 * len(sides[name].columns) <= broadcast_bytes
        elif p.k is not None:
            vector_rows = float(min(p.k, filtered.count()))
        else:
            states = states or States()
            rows = base.count()
            vector_rows = sampled(filtered, p.condition(distance(p.function, p.column, p.query)), states.get(base.sparkSession, name, p.column), rows)
            sides[name], seen = observed(sides[name], f"rows of {name}")
            teach = states, query, float(rows)
        estimates[name] = vector_rows
    for name, side in sides.items():
        if name not in estimates:
            estimates[name] = _guess(query.relations[name].select(*query.columns.get(name, query.relations[name].columns)), query.filters.get(name))
    order = _order(query, estimates) if query.is_vector_query() and mode != "off" else _given(query)
    framed = {n: (F.broadcast(s) if few and n == p.relation else s).alias(n) for n, s in sides.items()}
    joined, done = framed[order[0]], {order[0]}
    for name in order[1:]:
        conditions, kind = [], "inner"
        for j in query.joins:
            if name in (j.left, j.right) and ({j.left, j.right} - {name}) <= done:
                kind = "left" if j.kind == "left" else kind
                conditions += [F.col(f"{j.left}.{a}") == F.col(f"{j.right}.{b}") for a, b in j.keys]
        on = conditions[0] if conditions else F.lit(True)
        for c in conditions[1:]:
            on = on & c
        joined = joined.join(framed[name], on, kind)
        done.add(name)
    for condition in query.residual:
        joined = joined.filter(condition)
    return Plan(joined, order, estimates, vector_rows, few, used, kept, seen, teach, p.relation if p is not None else None)


def _index_of(p: VectorPredicate, catalog: Catalog | None, hint: str | None) -> str | None:
    """The index to read; none if its order is not the predicate's or the predicate looks away from the query."""
    if catalog is None or p.table is None or p.key is None or (p.k is None and p.compare not in ("<", "<=")):
        return None
    found = catalog.match(p.table, p.column, p.function, hint)
    return found.name if found and METRICS[found.metric] == p.function and found.key == p.key else None


def _by_index(side: DataFrame, p: VectorPredicate, catalog: Catalog, name: str, dist: str, keep_vector: bool) -> DataFrame:
    near = catalog.search(name, p.query, p.k, exact=True) if p.k is not None else catalog.range(name, p.query, p.radius, p.compare == "<=")
    near = near.select(F.col("key").alias("_index_key"), F.col("dist").alias(dist))
    found = (side if keep_vector else side.drop(p.column)).join(near, F.col(p.key) == F.col("_index_key"))
    return found.drop("_index_key")


def _by_scan(side: DataFrame, p: VectorPredicate, dist: str, keep_vector: bool) -> DataFrame:
    scored = side.withColumn(dist, F.explode(F.array(scan(p.function, p.column, p.query))))  # computed once
    if p.k is not None:
        found = scored.orderBy(F.col(dist).asc_nulls_last(), *([p.key] if p.key else [])).limit(p.k)
    else:
        found = scored.filter(p.condition(F.col(dist)))
    return found if keep_vector else found.drop(p.column)


def _given(query: VectorQuery) -> list[str]:
    """The order of the description, moved only where a relation would have nothing to join with."""
    left, order = list(query.relations), []
    while left:
        name = next((n for n in left if not order or _joins(query, n, order)), left[0])
        order.append(name)
        left.remove(name)
    return order


def _joins(query: VectorQuery, name: str, done: Sequence[str]) -> bool:
    """Whether a relation can be joined now; the right side of a left join only after its left side."""
    own = [j for j in query.joins if name in (j.left, j.right)]
    if any(j.kind == "left" and j.right == name and j.left not in done for j in own):
        return False
    return any(({j.left, j.right} - {name}) <= set(done) for j in own)


def _order(query: VectorQuery, estimates: dict[str, float]) -> list[str]:
    """The greedy order, from whichever relation makes it cheapest by the rows of all its steps.

    Joining a relation keeps its share of rows that its filters leave, and multiplies them where the
    relation is the larger one of the join: by how much larger it is than its partner.
    """
    whole = {n: max(_guess(df, None), estimates[n]) for n, df in query.relations.items()}
    optional = {j.right for j in query.joins if j.kind == "left"}

    def grown(start: str) -> tuple[float, list[str]]:
        order, rows, cost = [start], estimates[start], estimates[start]
        while len(order) < len(query.relations):
            left = [n for n in query.relations if n not in order]
            ready = [n for n in left if _joins(query, n, order)] or left

            def after(name: str) -> float:
                partners = [({j.left, j.right} - {name}).pop() for j in query.joins if name in (j.left, j.right)]
                fan = min((whole[name] / whole[x] for x in partners if x in order), default=whole[name])
                share = 1.0 if name in optional else min(1.0, estimates[name] / whole[name])
                return max(rows * share * max(1.0, fan), 1.0)

            best = min(ready, key=lambda n: (n in optional, after(n), estimates[n], n))
            rows = after(best)
            cost += rows
            order.append(best)
        return cost, order

    return min(grown(n) for n in query.relations if n not in optional)[1]


def duckdb_from(relations: dict[str, str], joins: Sequence[Join]) -> str:
    """The FROM clause of a description, relation by relation; outer joins come last."""
    optional = {j.right for j in joins if j.kind == "left"}
    left = sorted(relations, key=lambda n: n in optional)
    out, done = f"{relations[left[0]]} {left[0]}", {left.pop(0)}
    while left:
        name = next((n for n in left if any({j.left, j.right} - {n} <= done for j in joins if n in (j.left, j.right))), left[0])
        on = [f"{j.left}.{a} = {j.right}.{b}" for j in joins if name in (j.left, j.right) and {j.left, j.right} - {name} <= done for a, b in j.keys]
        out += f"\n{'LEFT JOIN' if name in optional else 'JOIN'} {relations[name]} {name} ON {' AND '.join(on) or 'true'}"
        done.add(name)
        left.remove(name)
    return out


def feedback(states: States, query: VectorQuery, estimated: float, true: float, table_rows: float) -> float:
    """The error of an estimate, learned for next time."""
    p, spark = query.predicate, query.relations[query.predicate.relation].sparkSession
    error = q_error(estimated, true)
    state = states.get(spark, p.relation, p.column)
    state.learn(error, table_rows, setting(spark, "vecsql.sample_update_cycle"), setting(spark, "vecsql.update_sample_size"))
    states.save()
    return error
