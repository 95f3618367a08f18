"""Near-duplicate embeddings: a graph per shard, every shard searched, links verified.

Equal vectors are one node. Nodes are dealt into shards by a hash, a navigable small-world graph
is built for each, and blocks of nodes are searched in every shard. Beams widen in two ways: a
query whose whole beam is linked is searched again with twice the beam until it isn't, and a block is
audited first: some of its queries that have links, by exact comparison and not counting themselves, are searched for with
wider and wider beams until on average nearly all links of a query are found; the whole block then gets that beam. A
block that fails with the widest one is compared with the shard as a whole, so no audit stays
failed. Links are verified in double precision. A block returns counts and a spanning forest of
its links, not the links, so a group of n copies costs n rows, and its forests make the components.
A link counts for the side that found it; both sides of a pair are searched for.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hnsw import Graph, build
from .linking import components
from .scratch import Scratch

COSINE = 0.9
#: Shards at least, and nodes and bytes that a shard holds at most, about. A node takes 12 bytes a dimension and a row of its graph.
SHARDS, SHARD_NODES, SHARD_BYTES, GRAPH_BYTES = 6, 50_000, 64 << 20, 256
#: Queries that a task searches for in one shard: so few until there are FEW_BLOCKS blocks, then so many. Each block gets each shard.
BLOCK_NODES, FEW_BLOCKS, LARGE_BLOCK = 16_384, 4, 65_536
BATCH = 256
#: Shards travel in rows of so many bytes: a row stands several times in the JVM and in Python.
PIECE_BYTES = 2 << 20
#: Beyond the last beam, comparing a query with a whole shard takes less time than the search.
FIRST_BEAM, LAST_BEAM = 32, 128
#: Queries with links that an audit takes, those it draws to find them, and the mean recall that it asks for.
AUDITED, DRAWN, LEAST_RECALL = 64, 4096, 0.99
#: Links that are made into a forest at once.
FOREST_LINKS = 1 << 20
#: What single precision may take from a cosine.
SLACK = 1e-5


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """As precise as the column."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _build(table: pa.Table) -> pa.Table:
    """Pieces of a shard: its nodes, copies and vectors, and the links of its graph in their order."""
    table = table.sort_by("node")
    nodes, copies, vectors = table.column("node").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("vector"))
    data = pickle.dumps((nodes, copies, vectors, build(_unit(vectors).astype(np.float32)).dumps(False)), 5)
    pieces = [data[a : a + PIECE_BYTES] for a in range(0, len(data), PIECE_BYTES)]
    same = [pa.array([table.column(c)[0].as_py()] * len(pieces), pa.int32()) for c in ("dim", "shard")]
    return pa.table([*same, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["dim", "shard", "piece", "data"])


def _shard(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    """Nodes, copies and unit vectors in double of a shard, and its graph."""
    nodes, copies, vectors, links = pickle.loads(b"".join(pieces.sort_by("piece").column("data").to_pylist()))
    exact = _unit(vectors)
    return nodes, copies, exact, Graph.loads(links, exact.astype(np.float32))


def spanning(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, after more links (a, b); root: before them."""
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def links_by_batches(graph: Graph, queries: np.ndarray, beam: int, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, numbers of the vectors that may be linked) for each query; beams widen until not all of one is. Beam 0: the shard as a whole.

    In no order and as they are found: those of a whole block, in a large group of copies, would take its square.
    """
    todo = np.arange(len(queries))
    n = len(graph.vectors)
    while len(todo):
        wide = min(beam, n)
        again = []
        for a in range(0, len(todo), BATCH):
            own = todo[a : a + BATCH]
            if not beam or wide >= n or wide > LAST_BEAM:  # as wide as a group: the shard as a whole is cheaper
                hit = queries[own] @ graph.vectors.T >= cosine - SLACK
                for q, h in zip(own.tolist(), hit, strict=True):
                    yield q, np.flatnonzero(h)
                continue
            ids, sims = graph.nearest(queries[own], wide)
            hit = (sims >= cosine - SLACK) & (ids >= 0)
            wider = hit.all(1)
            again.append(own[wider])
            for q in np.flatnonzero(~wider).tolist():
                yield int(own[q]), ids[q][hit[q]]
        todo = np.concatenate(again) if again else todo[:0]
        beam *= 2


def found_links(graph: Graph, queries: np.ndarray, beam: int, cosine: float) -> list[np.ndarray]:
    """For each query the numbers of the vectors that may be linked."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    for q, found in links_by_batches(graph, queries, beam, cosine):
        out[q] = found
    return out


def audit(graph: Graph, queries: np.ndarray, cosine: float, own: np.ndarray | None = None, seed: int = 3) -> tuple[int, float]:
    """The beam that passes (0: the shard as a whole) and its recall.

    own: for each query its own number in the graph, or -1; finding oneself doesn't count.
    """
    own = np.full(len(queries), -1) if own is None else own
    drawn = np.random.default_rng(seed).permutation(len(queries))[:DRAWN]
    some: list[int] = []
    truth: list[np.ndarray] = []
    for a in range(0, len(drawn), BATCH):
        part = drawn[a : a + BATCH]
        true = queries[part] @ graph.vectors.T >= cosine + SLACK
        at = np.flatnonzero(own[part] >= 0)
        true[at, own[part][at]] = False
        linked = np.flatnonzero(true.any(1))
        some += part[linked].tolist()
        truth += [np.flatnonzero(true[i]).astype(np.int32) for i in linked]
        if len(some) >= AUDITED:
            break
    beam = FIRST_BEAM
    while beam <= LAST_BEAM:
        found = found_links(graph, queries[some], beam, cosine)
        recall = float(np.mean([np.isin(t, f).mean() for t, f in zip(truth, found, strict=True)])) if some else 1.0
        if recall >= LEAST_RECALL:
            return beam, recall
        beam *= 2
    return 0, 1.0


def audited_links(graph: Graph, queries: np.ndarray, cosine: float, own: np.ndarray | None = None, seed: int = 3) -> tuple[list[np.ndarray], int, float]:
    """Links of all queries with the beam that passed the audit, that beam (0: the shard as a whole) and its recall."""
    beam, recall = audit(graph, queries, cosine, own, seed)
    return found_links(graph, queries, beam, cosine), beam, recall


def _search(cosine: float, queries: pa.Table, pieces: pa.Table) -> pa.Table:
    """Rows (node, other, copies, beam, recall): counts where other is null, else edges of a forest of the links."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("copies", pa.int64()), ("beam", pa.int32()), ("recall", pa.float64())])
    if not len(queries) or not len(pieces):
        return schema.empty_table()
    nodes, copies, theirs, graph = _shard(pieces)
    mine = queries.column("node").to_numpy()
    exact = _unit(_matrix(queries.column("vector")))
    order = np.argsort(nodes)
    place = order[np.minimum(np.searchsorted(nodes[order], mine), len(nodes) - 1)]
    own = np.where(nodes[place] == mine, place, -1)
    short = exact.astype(np.float32)
    beam, recall = audit(graph, short, cosine, own)
    every, numbers = np.unique(np.concatenate([nodes, mine]), return_inverse=True)
    root = np.arange(len(every))
    counts = np.zeros(len(mine), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def settle(root: np.ndarray) -> np.ndarray:
        a, b = np.repeat([q for q, _ in held], [len(f) for _, f in held]), np.concatenate([f for _, f in held])
        return spanning(numbers[len(nodes) + a], numbers[b], root)

    for q, found in links_by_batches(graph, short, beam, cosine):
        found = found[nodes[found] != mine[q]]
        if len(found):
            found = found[theirs[found] @ exact[q] >= cosine]
        if len(found):
            counts[q] = copies[found].sum()
            held.append((q, found))
            waiting += len(found)
            if waiting >= FOREST_LINKS:
                root, held, waiting = settle(root), [], 0
    if held:
        root = settle(root)
    some, edges = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(every)))
    none = lambda n, kind: pa.nulls(n, kind)
    return pa.concat_tables(
        [
            pa.table([pa.array(mine[some]), none(len(some), pa.int64()), pa.array(counts[some]), pa.array(np.full(len(some), beam, np.int32)), pa.array(np.full(len(some), recall))], schema=schema),
            pa.table([pa.array(every[edges]), pa.array(every[root[edges]]), *(none(len(edges), f.type) for f in list(schema)[2:])], schema=schema),
        ]
    )


def usable(vector: Column) -> Column:
    """Not null, not empty, finite, without nulls, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def linked(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row a row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Vectors link if their cosine in double precision is ``cosine`` or more; vectors of different
    lengths don't. One that is null, zero or holds nulls or non-finite numbers links with nothing and
    is its own component. Rows of equal vectors link with each other. A null vec_id is
    in a component like any other and never its smallest; a group of null ids has a null component.
    An empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(spark, "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    # single precision stays so while it is shuffled
    of_floats = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType)
    rows = vectors.select("vec_id", (F.col("embedding") if of_floats else F.col("embedding").cast("array<double>")).alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    # 128 bits stand for a vector, so that vectors are shuffled once
    hashes = [F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(n), "vector")).alias(f"hash_{n}") for n in (0, 1)]
    hashed = rows.select("vec_id", *hashes, "vector")
    same = hashed.filter("vector is not null").groupBy("hash_0", "hash_1")
    same = same.agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    # equal vectors share a row from here on; the number of a node is fixed by writing it
    nodes = scratch.save(same.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "nodes")
    n, numbers = nodes.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    # so few shards that each search is long enough, as many as tasks can hold
    shards = max(SHARDS, ceil(n / SHARD_NODES), ceil((12 * numbers + GRAPH_BYTES * n) / SHARD_BYTES))
    blocks = max(1, min(ceil(n / block_nodes), max(FEW_BLOCKS, ceil(n / LARGE_BLOCK))))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    built = dealt.select("dim", "shard", "node", "copies", "vector").groupBy("dim", "shard")
    graphs = scratch.save(built.applyInArrow(_build, "dim int, shard int, piece int, data binary"), "graphs")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = nodes.select("dim", "node", "vector", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    offered = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "shard", "block")
    searched = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(
        lambda queries, pieces: _search(cosine, queries, pieces), "node long, other long, copies long, beam int, recall double"
    )
    searched = scratch.save(searched, "searched")
    counts = searched.filter("other is null").groupBy("node").agg(F.sum("copies").alias("others"))
    roots = components(searched.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch, "groups")
    known = nodes.select("hash_0", "hash_1", "least_id", "copies", "node").join(counts, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    heads = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    n_links = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    known = known.join(heads, "root").select("hash_0", "hash_1", F.lit(True).alias("known"), n_links.alias("n_links"), "component_id")
    whole = hashed.drop("vector").join(known, ["hash_0", "hash_1"], "left")
    out = whole.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("known").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"),
    )
    return out.select(F.col("vec_id").cast(kind), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows in DuckDB for usable vectors with distinct ids: every pair is compared.
ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9
), r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM e UNION SELECT l.a, r.root FROM l JOIN r ON l.b = r.vec_id
), c AS (
  SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
