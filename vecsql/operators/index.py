"""Approximate indexes as partitioned tables, and their catalog.

An index is a folder: the vectors of its table, partitioned by the nearest of some centroids, the
centroids, rows and radius of each cell, the keys that were deleted, and one small file that describes
it. Every change has a number and writes folders of that number; it counts once the description
says so, which is one rename. A change that broke off is overwritten by the next one. A deleted key
hides the rows of smaller numbers only, so a key may come back.

A search reads the cells nearest to the query. With ``exact=True`` a cell is read if the triangle
inequality does not rule it out, so nothing within the radius is lost; that holds for 'l2sq', for
'cosine' on normalised vectors, and not for 'ip', whose searches then read every cell.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsql.functions.distance import METRICS, distance, metric_of, scan
from vecsql.operators.search import BLOCK_BYTES, BLOCK_ROWS, _block, _bytes, _side, knn_join

#: The options and their defaults.
DEFAULTS = {"metric": "l2sq", "ef_construction": 128, "ef_search": 64, "M": 16, "M0": 32}
_LEAST = {"ef_construction": 1, "ef_search": 1, "M": 2, "M0": 2}

#: Rows that the centroids are fitted on, at most, and rounds of fitting.
SAMPLE_ROWS = 20_000
ROUNDS = 8
#: Settings of a session: rows to look at, read at search time; whether indexes may be kept in folders, read when one is made.
EF_SEARCH = "vecsql.ef_search"
PERSISTENCE = "vecsql.enable_experimental_persistence"


class StatementError(ValueError):
    """A statement about an index that can't be carried out. The texts of these errors."""


def check_options(options: dict) -> dict:
    """The options with defaults, or the error that names the first wrong one."""
    lower = {k.lower(): k for k in DEFAULTS}
    out = dict(DEFAULTS)
    for name, value in options.items():
        known = lower.get(name.lower())
        if known is None:
            raise StatementError(f"Unknown option for HNSW index: '{name}'")
        if known == "metric":
            if not isinstance(value, str):
                raise StatementError("HNSW index 'metric' must be a string")
            if value not in METRICS:
                raise StatementError(f"HNSW index 'metric' must be one of: {', '.join(repr(m) for m in METRICS)}")
        else:
            if not isinstance(value, int) or isinstance(value, bool):
                raise StatementError(f"HNSW index '{known}' must be an integer")
            if value < _LEAST[known]:
                raise StatementError(f"HNSW index '{known}' must be at least {_LEAST[known]}")
        out[known] = value
    return out


@dataclass
class Index:
    name: str
    table: str
    column: str
    key: str
    dimensions: int
    options: dict
    path: str
    cells: int
    version: int = 0
    catalog_name: str = "spark_catalog"
    schema_name: str = "default"
    extra: dict = field(default_factory=dict)

    @property
    def metric(self) -> str:
        return self.options["metric"]


class Files:
    """Small files by Hadoop paths, so that any store Spark reaches will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A new file: beside its place, then renamed onto it."""
        fs, p = self._at(path)
        other = self.jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        out = fs.create(other, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not fs.rename(other, p):
            raise OSError(f"can't rename {path}.new")

    def copy(self, path: str, to: str) -> None:
        (a, p), (b, q) = self._at(path), self._at(to)
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, self.spark._jsc.hadoopConfiguration()):
            raise OSError(f"can't copy {path}")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def _prepared(metric: str, vectors: np.ndarray) -> np.ndarray:
    if metric != "cosine":
        return vectors
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _fit(vectors: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's method from distinct starting rows."""
    distinct = np.unique(vectors, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(ROUNDS):
        own = _nearest(vectors, centroids)
        for c in range(len(centroids)):
            mine = vectors[own == c]
            if len(mine):
                centroids[c] = mine.mean(0)
    return centroids


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(vectors), 8192):
        v = vectors[a : a + 8192]
        out.append(((centroids * centroids).sum(1) - 2 * v @ centroids.T).argmin(1))
    return np.concatenate(out)


class Cursor:
    """Neighbours of a query in exact order, some at a time; between calls it holds the last one only."""

    def __init__(self, catalog: Catalog, name: str, query: list[float]):
        self.catalog, self.name, self.query, self.last, self.open = catalog, name, query, None, True

    def next(self, n: int = 1) -> list[tuple]:
        """The next (key, dist), n at most; none when all were given or after ``close``."""
        if not self.open or n < 1:
            return []
        rows = [(r.key, r.dist) for r in self.catalog.search(self.name, self.query, n, exact=True, after=self.last).collect()]
        if rows:
            self.last = rows[-1][1], rows[-1][0]
        self.open = len(rows) == n
        return rows

    def close(self) -> None:
        self.open = False


class Catalog:
    """Indexes below one folder. ``tables`` are named by the caller; an index keeps a copy of the vectors it was made from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    # definitions

    def _described(self, folder: str) -> list[str]:
        return [n for n in self.files.names(folder) if n.startswith("index-") and n.endswith(".json")]

    def _save(self, index: Index) -> None:
        """A next description; the one before stays for readers that have just looked for it."""
        folder = f"{self.root}/{index.name}"
        old = self._described(folder)
        self.files.write(f"{folder}/index-{int(old[-1][6:-5]) + 1 if old else 0:010d}.json", json.dumps(asdict(index)))
        for name in old[:-1]:
            self.files.delete(f"{folder}/{name}")

    def _load(self, folder: str) -> Index | None:
        for _ in range(5):
            names = self._described(folder)
            if not names:
                return None
            text = self.files.read(f"{folder}/{names[-1]}")
            if text is not None:
                return Index(**json.loads(text))
        raise OSError(f"the description of {folder} keeps changing")

    def get(self, name: str) -> Index:
        index = self._load(f"{self.root}/{name}")
        if index is None:
            raise StatementError(f"Index {name} not found")
        return index

    def all(self) -> list[Index]:
        found = (self._load(f"{self.root}/{n}") for n in self.files.names(self.root))
        return [i for i in found if i is not None]

    def note(self, name: str, **extra) -> None:
        """Facts to keep with an index."""
        index = self.get(name)
        index.extra |= extra
        self._save(index)

    def match(self, table: str, column: str, function: str, hint: str | None = None) -> Index | None:
        """An index of the column whose metric serves the function's order; ``hint`` names the one to take."""
        metric = metric_of(function)
        if hint is not None:
            index = self.get(hint)
            if (index.table, index.column, index.metric) != (table, column, metric):
                raise StatementError(f"Index {hint} does not serve {function} on {table}.{column}")
            return index
        return next((i for i in self.all() if (i.table, i.column, i.metric) == (table, column, metric)), None)

    # statements

    def create(self, name: str, table: str, df: DataFrame, column: str, key: str, dimensions: int | None = None, unique: bool = False, cells: int | None = None, **options) -> Index:
        """Rows with a NULL vector are left out; the centroids are fitted on a sample, all rows are assigned."""
        if unique:
            raise NotImplementedError("HNSW indexes do not support unique or primary key constraints")
        if self.spark.conf.get(PERSISTENCE, "true").lower() not in ("true", "on", "1"):
            # fixed text, but for the name of the setting
            raise StatementError(f"HNSW indexes can only be created in in-memory databases, or when the configuration option '{PERSISTENCE}' is set to true.")
        kind = df.schema[column].dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.FloatType | T.DoubleType):
            raise StatementError("HNSW index can only be created over FLOAT[N] keys.")
        chosen = check_options(options)
        if self._load(f"{self.root}/{name}") is not None:
            raise StatementError(f'Index with name "{name}" already exists')
        rows = df.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector")).filter("vector is not null")
        n = rows.count()
        cells = cells or max(1, min(4096, int(n**0.5 / 2)))
        sample = rows.select("vector").sample(min(1.0, 1.2 * SAMPLE_ROWS / max(n, 1)), seed=5).limit(SAMPLE_ROWS).toPandas()["vector"] if n else []
        if n and not len(sample):
            sample = rows.select("vector").limit(SAMPLE_ROWS).toPandas()["vector"]
        first = rows.select(F.size("vector").alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
        if first.lo != first.hi:
            raise StatementError(f"vectors have different dimensions: {first.lo} and {first.hi}")
        dimensions = dimensions or first.lo or 0
        centroids = _fit(_prepared(chosen["metric"], np.stack([np.asarray(v, float) for v in sample])), cells) if len(sample) else np.zeros((1, dimensions))
        index = Index(name, table, column, key, dimensions, chosen, f"{self.root}/{name}", len(centroids), extra={"key_type": df.schema[key].dataType.simpleString()})
        self._begin(index, centroids)
        self._write(index, rows, centroids)
        self._save(index)
        return index

    def _begin(self, index: Index, centroids: np.ndarray) -> None:
        """A version's centroids, and its first change to come."""
        index.extra |= {"change": -1, "deletes": False}
        rows = [(c, [float(x) for x in v]) for c, v in enumerate(centroids)]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self._folder(index)}/centroids")

    def _folder(self, index: Index) -> str:
        return f"{index.path}/v{index.version}"

    def _assigned(self, index: Index, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        shared, metric = self.spark.sparkContext.broadcast(centroids), index.metric

        def run(batches):
            for batch in batches:
                column = batch.column(1)
                if not len(batch):
                    continue
                v = np.stack([np.asarray(x, float) for x in column.to_numpy(zero_copy_only=False)])
                p = _prepared(metric, v)
                cell = _nearest(p, shared.value)
                away = np.sqrt(((p - shared.value[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cell.astype(np.int32))], ["key", "vector", "away", "cell"])

        return rows.mapInArrow(run, f"key {index.extra['key_type']}, vector array<double>, away double, cell int")

    def _write(self, index: Index, rows: DataFrame, centroids: np.ndarray) -> None:
        """Rows as the index's next change: written by cells, large ones by several tasks, and counted by cells."""
        index.extra["change"] += 1
        at, change = self._folder(index), f"change={index.extra['change']}"
        assigned = self._assigned(index, rows, centroids).hint("rebalance", "cell")
        assigned.write.mode("overwrite").partitionBy("cell").parquet(f"{at}/cells/{change}")
        written = self.spark.read.schema(f"{self._schema(index)}, cell int").parquet(f"{at}/cells/{change}")
        written.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{at}/stats/{change}")

    def _schema(self, index: Index) -> str:
        return f"key {index.extra['key_type']}, vector array<double>, away double"

    def _centroids(self, index: Index) -> list:
        """(cell, centroid, n, radius): as many as cells, 4,096 at most."""
        at = self._folder(index)
        stats = self.spark.read.schema("cell int, n long, radius double, change long").parquet(f"{at}/stats").filter(F.col("change") <= index.extra["change"])
        stats = stats.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        found = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{at}/centroids").join(stats, "cell", "left").fillna(0, ["n", "radius"])
        return sorted(found.collect(), key=lambda r: r.cell)

    def insert(self, name: str, df: DataFrame, **facts) -> None:
        """Rows that the table got since; they are assigned to the cells there are. ``facts`` are noted together with them."""
        index = self.get(name)
        rows = df.select(F.col(index.key).alias("key"), F.col(index.column).cast("array<double>").alias("vector")).filter("vector is not null")
        if not index.dimensions:  # made over an empty table: fitted with the first rows
            kept = {k: v for k, v in index.extra.items() if k not in ("change", "deletes", "key_type")}
            self.drop(name)
            self.create(name, index.table, df, index.column, index.key, **index.options)
            self.note(name, **kept, **facts)
            return
        rows = rows.withColumn("vector", F.when(F.size("vector") == index.dimensions, F.col("vector")).otherwise(F.raise_error(F.lit(f"vectors must have {index.dimensions} dimensions")).cast("array<double>")))
        self._write(index, rows, np.array([r.centroid for r in self._centroids(index)]))
        index.extra |= facts
        self._save(index)

    def delete(self, name: str, keys: DataFrame, **facts) -> None:
        """Keys whose rows are left out from now on; the rows go when the index is compacted. Later rows of a key are seen again."""
        index = self.get(name)
        index.extra["change"] += 1
        gone = keys.select(F.col(keys.columns[0]).cast(index.extra["key_type"]).alias("key")).distinct()
        gone.write.mode("overwrite").parquet(f"{self._folder(index)}/deleted/change={index.extra['change']}")
        index.extra |= {"deletes": True} | facts
        self._save(index)

    def compact(self, name: str) -> None:
        """The cells written anew without deleted rows, as a next version; readers of the old one are not disturbed until it goes."""
        index = self.get(name)
        live, centroids = self.rows(name), np.array([r.centroid for r in self._centroids(index)])
        old = self._folder(index)
        index.version += 1
        self._begin(index, centroids)
        self._write(index, live.select("key", "vector"), centroids)
        self._save(index)
        self.files.delete(old)

    def drop(self, name: str) -> None:
        self.get(name)
        self.files.delete(f"{self.root}/{name}")

    def rename_key(self, name: str, old, new) -> None:
        """One key for another, as a delete and an insert."""
        index = self.get(name)
        row = self.rows(name).filter(F.col("key") == F.lit(old)).select(F.lit(new).cast(index.extra["key_type"]).alias(index.key), F.col("vector").alias(index.column))
        row = self.spark.createDataFrame(row.collect(), row.schema)
        self.delete(name, self.spark.createDataFrame([(old,)], f"key {index.extra['key_type']}"))
        self.insert(name, row)

    def copy(self, name: str, new: str) -> Index:
        index = self.get(name)
        rows = self.rows(name).select(F.col("key").alias(index.key), F.col("vector").alias(index.column))
        return self.create(new, index.table, rows, index.column, index.key, **index.options)

    def fork(self, name: str, new: str) -> Index:
        """An index of the same options and cells without rows."""
        index = self.get(name)
        if self._load(f"{self.root}/{new}") is not None:
            raise StatementError(f'Index with name "{new}" already exists')
        centroids = np.array([r.centroid for r in self._centroids(index)])
        other = Index(new, index.table, index.column, index.key, index.dimensions, dict(index.options), f"{self.root}/{new}", index.cells, extra={"key_type": index.extra["key_type"]})
        self._begin(other, centroids)
        self._write(other, self.spark.createDataFrame([], f"key {index.extra['key_type']}, vector array<double>"), centroids)
        self._save(other)
        return other

    def isolate(self, name: str) -> int:
        """How many rows of deleted keys still stand in cells; they go, so that nothing leads to them."""
        index = self.get(name)
        hidden = sum(r.n for r in self._centroids(index)) - self.count(name) if index.extra.get("deletes") else 0
        if hidden:
            self.compact(name)
        return hidden

    def save(self, name: str, path: str) -> None:
        """The index as one folder elsewhere."""
        index = self.get(name)
        self.files.delete(path)
        self.files.copy(self._folder(index), f"{path}/v{index.version}")
        self.files.write(f"{path}/index-0000000000.json", json.dumps(asdict(index) | {"path": path}))

    def peek(self, path: str) -> dict:
        """What a saved index is, without its rows."""
        index = self._load(path.rstrip("/"))
        if index is None:
            raise StatementError(f"Index {path} not found")
        return asdict(index)

    def load(self, path: str, name: str) -> Index:
        """A saved index under a name, copied."""
        index = self.view(path, name)
        self.files.copy(f"{index.path}/v{index.version}", f"{self.root}/{name}/v{index.version}")
        index.path = f"{self.root}/{name}"
        self._save(index)
        return index

    def view(self, path: str, name: str) -> Index:
        """A saved index under a name, read where it is."""
        if self._load(f"{self.root}/{name}") is not None:
            raise StatementError(f'Index with name "{name}" already exists')
        index = Index(**self.peek(path) | {"name": name, "path": path.rstrip("/")})
        self._save(index)
        return index

    def merge(self, *_):
        raise NotImplementedError("HNSWIndex::MergeIndexes() not implemented")

    def verify(self, *_):
        raise NotImplementedError("HNSWIndex::VerifyAndToString() not implemented")

    # reading

    def rows(self, name: str, cells: Sequence[int] | None = None) -> DataFrame:
        """(key, vector, away, cell) of the live rows; only the folders of the given cells are read."""
        index = self.get(name)
        at = self._folder(index)
        df = self.spark.read.schema(f"{self._schema(index)}, change long, cell int").parquet(f"{at}/cells").filter(F.col("change") <= index.extra["change"])
        df = df if cells is None else df.filter(F.col("cell").isin([int(c) for c in cells]))
        if index.extra.get("deletes"):
            gone = self.spark.read.schema(f"key {index.extra['key_type']}, change long").parquet(f"{at}/deleted").filter(F.col("change") <= index.extra["change"])
            gone = gone.groupBy(F.col("key").alias("gone")).agg(F.max("change").alias("last"))
            df = df.join(gone, (F.col("key") == F.col("gone")) & (F.col("change") < F.col("last")), "left_anti")
        return df.select("key", "vector", "away", "cell")

    def contains(self, name: str, key) -> bool:
        return bool(self.rows(name).filter(F.col("key") == F.lit(key)).take(1))

    def count(self, name: str) -> int:
        return self.rows(name).count()

    def vector_of(self, name: str, key) -> list[float] | None:
        row = self.rows(name).filter(F.col("key") == F.lit(key)).select("vector").first()
        return list(row.vector) if row else None

    def _probed(self, index: Index, query: np.ndarray, cells: int | None, radius: float | None) -> list[int]:
        info = self._centroids(index)
        if not info:
            return []
        q = _prepared(index.metric, query[None])[0]
        centroids, spread = np.array([r.centroid for r in info]), np.array([r.radius for r in info])
        full = np.array([r.n > 0 for r in info])
        if index.metric == "ip":  # of a cell, no inner product is larger than the centroid's plus |q| times the radius
            least = -(centroids @ q) - np.linalg.norm(q) * spread
            reach, order = radius, least
        else:
            order = np.sqrt(((centroids - q) ** 2).sum(1))
            least = order - spread
            reach = radius if index.metric == "l2sq" or radius is None else np.sqrt(max(0.0, 2 * radius))
        if radius is not None:
            return np.flatnonzero(full & (least <= reach + 1e-9)).tolist()
        return [int(c) for c in np.argsort(order, kind="stable") if full[c]][:cells]

    def probes(self, index: Index) -> int:
        """Cells that a search reads: those that hold ``ef_search`` rows many times over, at least an eighth."""
        return max(1, min(index.cells, max(index.cells // 8, -(-self.ef(index) // 16))))

    def estimate(self, name: str, k: int | None = None, ef: bool = False) -> int:
        """Rows that a search gives: k or, without a limit, as many as ``ef_search``, of those there are. Nothing is read but counts."""
        index = self.get(name)
        rows = sum(r.n for r in self._centroids(index)) if not index.extra.get("deletes") else self.count(name)
        most = [rows] + ([] if k is None else [k]) + ([self.ef(index)] if ef else [])
        return min(most)

    def ef(self, index: Index) -> int:
        return int(self.spark.conf.get(EF_SEARCH, str(index.options["ef_search"])))

    def search(self, name: str, query: Sequence[float], k: int, where: Column | None = None, cells: int | None = None, exact: bool = False, after: tuple | None = None) -> DataFrame:
        """(key, dist) of the k nearest; ``where`` is on key and applies before. ``after``: only what follows this (dist, key)."""
        index = self.get(name)
        query = np.asarray(query, float)
        if index.dimensions and len(query) != index.dimensions:
            raise ValueError(f"vectors have different dimensions: {index.dimensions} and {len(query)}")
        function = METRICS[index.metric]

        def ranked(probed: Sequence[int] | None) -> DataFrame:
            rows = self.rows(name, probed)
            rows = rows if where is None else rows.filter(where)
            scored = rows.select("key", scan(function, "vector", query.tolist()).alias("dist"))
            if after is not None:
                scored = scored.filter((F.col("dist") > after[0]) | (F.col("dist") == after[0]) & (F.col("key") > F.lit(after[1])))
            return scored.orderBy("dist", "key").limit(k)

        if not exact:
            return ranked(self._probed(index, query, cells or self.probes(index), None))
        # the k-th distance of a first search bounds the radius that has to be read
        near = ranked(self._probed(index, query, self.probes(index), None)).collect()
        return ranked(self._probed(index, query, None, near[-1].dist) if len(near) == k and k else None)

    def range(self, name: str, query: Sequence[float], radius: float, inclusive: bool = False) -> DataFrame:
        """(key, dist) of all rows within the radius: cells are ruled out, rows are not missed."""
        index = self.get(name)
        query = np.asarray(query, float)
        found = self.rows(name, self._probed(index, query, None, radius)).select("key", F.explode(F.array(scan(METRICS[index.metric], "vector", query.tolist()))).alias("dist"))
        return found.filter(F.col("dist") <= radius if inclusive else F.col("dist") < radius)

    def relaxed(self, name: str, query: Sequence[float], radius: float, patience: int = 4) -> DataFrame:
        """Cells are read in the order of their centroids until ``patience`` of them in a row, after one that held a match, held none.

        They are looked at in waves, each twice as wide as the one before, so no more than about twice
        the cells that the rule takes are read.
        """
        index = self.get(name)
        order = self._probed(index, np.asarray(query, float), index.cells, None)

        def matching(cells: Sequence[int]) -> DataFrame:
            rows = self.rows(name, cells).select("key", "cell", distance(METRICS[index.metric], "vector", list(query)).alias("dist"))
            return rows.filter(F.col("dist") < radius)

        taken, dry, met, at, wide = [], 0, False, 0, max(1, patience)
        while at < len(order):
            hits = {r.cell for r in matching(order[at : at + wide]).select("cell").distinct().collect()}
            for cell in order[at : at + wide]:
                taken.append(cell)
                met |= cell in hits
                dry = 0 if cell in hits else dry + 1
                if met and dry >= patience:
                    return matching(taken).select("key", "dist")
            at, wide = at + wide, 2 * wide
        return matching(taken).select("key", "dist")

    def iterate(self, name: str, query: Sequence[float]) -> Cursor:
        """Neighbours in order, some at a time."""
        return Cursor(self, name, [float(x) for x in query])

    def weighted(self, terms: Sequence[tuple[float, str, Sequence[float]]], k: int, wave: int = 50, limit: int | None = None) -> list[tuple]:
        """(key, score) of the k smallest weighted sums of squared distances over several 'l2sq' indexes of the same keys.

        terms: weight (0 or more), index, query. In turn, each index gives its next ``wave`` neighbours; their
        distances in the other indexes are looked up. It stops when no key not yet seen can be better than the k-th, as the sum at
        the indexes' last distances bounds it from below, or after ``limit`` keys. A key that an index lacks is left out.
        """
        if any(w < 0 or self.get(n).metric != "l2sq" for w, n, _ in terms):
            raise ValueError("weighted searches need weights of 0 or more and 'l2sq' indexes")
        cursors, seen, reach, best = [self.iterate(n, q) for _, n, q in terms], set(), [0.0] * len(terms), []
        while k:
            fresh, ended = set(), False
            for i, cursor in enumerate(cursors):
                rows = cursor.next(wave)
                ended |= len(rows) < wave
                reach[i] = rows[-1][1] if rows else reach[i]
                fresh |= {key for key, _ in rows} - seen
            if fresh:
                seen |= fresh
                wanted = self.spark.createDataFrame([(x,) for x in fresh], f"key {self.get(terms[0][1]).extra['key_type']}")
                score, joined = F.lit(0.0), wanted
                for i, (weight, name, query) in enumerate(terms):
                    part = self.rows(name).join(F.broadcast(wanted), "key", "left_semi").select("key", distance("l2sq", "vector", list(query)).alias(f"d{i}"))
                    joined, score = joined.join(part, "key"), score + F.lit(float(weight)) * F.col(f"d{i}")
                best = sorted([*best, *((r.key, r.score) for r in joined.select("key", score.alias("score")).orderBy("score", "key").limit(k).collect())], key=lambda r: (r[1], r[0]))[:k]
            bound = sum(w * d * d for (w, _, _), d in zip(terms, reach, strict=True))
            if ended or (limit is not None and len(seen) >= limit) or (len(best) == k and best[-1][1] < bound):
                break
        return best

    def clusters(self, name: str, n: int | None = None) -> DataFrame:
        """(key, cluster) of all live rows: their cells or, with n, groups of cells by Lloyd's method over the centroids."""
        index = self.get(name)
        info = self._centroids(index)
        if n is None or n >= len(info):
            return self.rows(name).select("key", F.col("cell").alias("cluster"))
        centroids = _prepared(index.metric, np.array([r.centroid for r in info]))
        group = _nearest(centroids, _fit(centroids.copy(), n))
        return self.rows(name).select("key", F.element_at(F.array(*[F.lit(int(g)) for g in group]), F.col("cell") + 1).alias("cluster"))

    def nearest_cluster(self, name: str, query: Sequence[float]) -> int | None:
        """The non-empty cell whose centroid is nearest."""
        found = self._probed(self.get(name), np.asarray(query, float), 1, None)
        return found[0] if found else None

    def recall(self, name: str, queries: Sequence[Sequence[float]], k: int, cells: int | None = None) -> float:
        """Share of the exact k nearest that the pruned search finds, over the queries."""
        found = wanted = 0
        for q in queries:
            true = {r.key for r in self.search(name, q, k, exact=True).collect()}
            found += len(true & {r.key for r in self.search(name, q, k, cells=cells).collect()})
            wanted += len(true)
        return found / wanted if wanted else 1.0

    def info(self) -> DataFrame:
        """One row an index; the cells stand where a graph has levels."""
        rows = []
        for i in self.all():
            cells = self._centroids(i)
            n = self.count(i.name)
            capacity = sum(r.n for r in cells)
            stats = [(r.cell, r.n, float(r.radius)) for r in cells]
            rows.append((i.catalog_name, i.schema_name, i.name, i.table, i.metric, i.dimensions, n, capacity, capacity * (8 * i.dimensions + 24), len(cells), stats))
        return self.spark.createDataFrame(
            rows,
            "catalog_name string, schema_name string, index_name string, table_name string, metric string, dimensions int, count long, capacity long, "
            "approx_memory_usage long, levels int, levels_stats array<struct<cell:int,nodes:long,radius:double>>",
        )


def knn_join_indexed(catalog: Catalog, name: str, left: DataFrame, left_key: str, left_vector: str, k: int, cells: int | None = None) -> DataFrame:
    """(left_key, key, dist, rank): for each left row the k nearest of the probed cells; left rows without a vector have none.

    A left row goes to its nearest cells and meets only their rows, block by block as in ``search.knn_join``; where
    all cells are probed the blocks are those of that join. No pair of rows is a row beyond k for each left row and block.
    """
    index = catalog.get(name)
    info = catalog._centroids(index)
    centroids = np.array([r.centroid for r in info])
    n, function = min(cells or catalog.probes(index), len(centroids)), METRICS[index.metric]
    asked = left.select(F.col(left_key), F.col(left_vector).cast("array<double>").alias("_v"))
    asked = asked.filter(F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull()))
    rows = catalog.rows(name)
    if n >= len(centroids):
        return knn_join(asked, rows.select("key", "vector"), left_key, "_v", "key", "vector", k, function).toDF(left_key, "key", "dist", "rank")
    # blocks of the left side, and for each cell blocks of its rows
    n_l = max(1, -(-_bytes(asked, "_v") // BLOCK_BYTES))
    parts = np.array([max(1, -(-r.n * 8 * len(r.centroid) // BLOCK_BYTES)) for r in info])
    shared, metric = catalog.spark.sparkContext.broadcast((centroids, parts)), index.metric
    asked = asked.withColumn("_a", F.pmod(F.xxhash64(left_key), F.lit(n_l)).cast("int")).toDF("_l", "_v", "_a")

    def probed(batches):
        for batch in batches:
            if not len(batch):
                continue
            centroids, parts = shared.value
            p = _prepared(metric, np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
            near = np.argsort((centroids**2).sum(1) - 2 * p @ centroids.T, axis=1, kind="stable")[:, :n].ravel()
            own = np.repeat(np.repeat(np.arange(len(batch)), n), parts[near])
            part = np.arange(len(own)) - np.repeat(np.cumsum(parts[near]) - parts[near], parts[near])
            for a in range(0, len(own), BLOCK_ROWS):
                some = slice(a, a + BLOCK_ROWS)
                whole = batch.take(pa.array(own[some]))
                yield pa.RecordBatch.from_arrays([*whole.columns, *(pa.array(x[some].astype(np.int32)) for x in (np.repeat(near, parts[near]), part))], ["_l", "_v", "_a", "cell", "_p"])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        kind = y.schema.field("key").type
        return pa.Table.from_batches([_block(x.column("_l"), x.column("_v"), _side(y.column("key"), y.column("vector"), k), k, function, kind)])

    kind = asked.schema["_l"].dataType.simpleString()
    lefts = asked.mapInArrow(probed, f"_l {kind}, _v array<double>, _a int, cell int, _p int")
    of_cell = F.element_at(F.array(*(F.lit(int(x)) for x in parts)), F.col("cell") + 1) if parts.max() > 1 else F.lit(1)
    rights = rows.select("key", "vector", "cell", F.pmod(F.xxhash64("key"), of_cell).cast("int").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(n_l - 1))).alias("_a"))
    keys = ("cell", "_p", "_a")
    best = lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(meet, f"_l {kind}, _r {index.extra['key_type']}, _d double").toDF("_l", "key", "dist")
    order = Window.partitionBy("_l").orderBy(F.col("dist").asc_nulls_last(), F.col("key").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("_l", left_key)
