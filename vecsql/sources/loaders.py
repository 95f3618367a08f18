"""Readers and writers of the formats that vector benchmarks come in."""

from __future__ import annotations

import io
import json
import pickle
import struct
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsql.storage import fixed

#: By suffix: type of an element in the file. Each file begins with two int32: rows and dimensions.
VECTOR_FILES = {"fbin": "<f4", "u8bin": "u1", "i8bin": "i1", "ibin": "<i4"}
#: Bytes of vectors that one task reads.
SPLIT_BYTES = 32 << 20


def read_vectors(spark: SparkSession, path: str, first: int = 0, count: int | None = None, scale: float | None = None, kind: str | None = None) -> DataFrame:
    """(ordinal, vector) of rows ``first`` and on of a .fbin or .u8bin file, as floats, times ``scale`` if given.

    Up to SPLIT_BYTES a file comes through Spark's own reader, so any store will do; a larger one is
    read by ranges of rows in as many tasks, through Arrow's file systems.
    """
    dtype = np.dtype(VECTOR_FILES[kind or path.rsplit(".", 1)[-1]])
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        rows, dims = struct.unpack("<ii", bytes((stream.read() & 255) for _ in range(8)))
    finally:
        stream.close()
    last = rows if count is None else min(rows, first + count)
    schema = "ordinal long, vector array<float>"
    if first >= last:
        return spark.createDataFrame([], schema)
    width = dims * dtype.itemsize
    step = max(1, SPLIT_BYTES // width)
    starts = spark.range(0, -(-(last - first) // step), 1, -(-(last - first) // step)).select((F.col("id") * step + first).alias("start"))
    whole = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = min(step, last - start)
                data = np.frombuffer(content.as_buffer(), dtype, n * dims, 8 + start * width).astype(np.float32)
                data = data * np.float32(scale) if scale is not None else data
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), lists], ["ordinal", "vector"])

    return starts.join(F.broadcast(whole)).mapInArrow(run, schema) if rows * width <= SPLIT_BYTES else _ranged(path, starts, step, last, dims, dtype, scale, schema)


def _ranged(path: str, starts: DataFrame, step: int, last: int, dims: int, dtype: np.dtype, scale: float | None, schema: str) -> DataFrame:
    """A file too large for one record: each task reads its range of rows through Arrow's file systems."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                n = min(step, last - start)
                with store.open_input_file(at) as file:
                    data = np.frombuffer(file.read_at(n * dims * dtype.itemsize, 8 + start * dims * dtype.itemsize), dtype).astype(np.float32)
                data = data * np.float32(scale) if scale is not None else data
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), lists], ["ordinal", "vector"])

    return starts.mapInArrow(run, schema)


def write_vectors(df: DataFrame, column: str, order: str, path: str, kind: str = "fbin") -> None:
    """One .fbin or .u8bin file of a local path, row by row from the executors: for exports of a machine's size."""
    rows = df.count()
    with open(path, "wb") as out:
        n = 0
        for row in df.orderBy(order).select(column).toLocalIterator():
            v = np.asarray(row[0]).astype(np.dtype(VECTOR_FILES[kind]))
            if not n:
                out.write(struct.pack("<ii", rows, len(v)))
            out.write(v.tobytes())
            n += 1
        if not n:
            out.write(struct.pack("<ii", 0, 0))


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "|", columns: int | None = None) -> DataFrame:
    """``.tbl`` and ``.dat`` files: fields parted, and usually also ended, by a bar; the first columns only, if asked for."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # what stands after the last bar, if one ends the line, is one more empty field
    padded = T.StructType([*schema.fields, T.StructField("_rest", T.StringType())])
    df = spark.read.csv(path, sep=sep, schema=padded, nullValue="", mode="PERMISSIVE", enforceSchema=True)
    return df.select(*schema.names[: columns or len(schema)])


def zip_rows(table: DataFrame, vectors: DataFrame, order: Sequence[str], name: str = "vector", ordinal: str = "ordinal") -> DataFrame:
    """Row i of the table, in the given order, with vector i.

    The sorted rows are written once with the number of their range and their place in it; ordinals add the
    rows of the ranges before: a distributed sort, not one task that numbers everything.
    """
    placed = fixed(table.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    counts = placed.groupBy("_part").count().orderBy("_part").collect()  # a number a range
    sums = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    before = table.sparkSession.createDataFrame([(r["_part"], n) for r, n in zip(counts, sums, strict=False)], "_part long, _before long")
    numbered = placed.join(F.broadcast(before), "_part").withColumn("_ordinal", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before"))
    right = vectors.select(F.col(ordinal).alias("_ordinal"), F.col("vector").alias(name))
    return numbered.drop("_place", "_part", "_before").join(right, "_ordinal", "left").drop("_ordinal")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, tags) from a JSON file that holds a list of lists of ints, or from JSON lines of such lists."""
    first = spark.read.text(path).first()
    if first is None or first.value.lstrip().startswith("[["):
        found = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<int>>")).alias("ordinal", "tags"))
        return found.select(F.col("ordinal").cast("long"), "tags")
    # lines are numbered by the blocks that a file is read in
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    blocks = lines.groupBy("block").agg(F.min("place").alias("first"), F.count("*").alias("count")).orderBy("block").collect()
    sums = np.cumsum([0, *(b["count"] for b in blocks)]).tolist()
    table = spark.createDataFrame([(tuple(b["block"]), b["first"], n) for b, n in zip(blocks, sums, strict=False)], "block struct<file_path:string,file_block_start:long>, first long, before long")
    numbered = lines.join(F.broadcast(table), "block").withColumn("ordinal", F.col("place") - F.col("first") + F.col("before"))
    return numbered.select("ordinal", F.from_json("value", "array<int>").alias("tags"))


def attach_tags(numbered: DataFrame, tags: DataFrame, ordinal: str = "ordinal", name: str = "tags") -> DataFrame:
    """Rows without tags get an empty list, tags without a row go."""
    right = tags.select(F.col("ordinal").alias("_o"), F.col("tags").alias(name))
    return numbered.join(right, numbered[ordinal] == F.col("_o"), "left").drop("_o").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))


def index_lists(entries: DataFrame, rows: int | None = None, threshold: float | None = None) -> DataFrame:
    """(row, indices): the sorted columns of the entries (row, col, val), those above the threshold if one is given.

    With ``rows``, each row number below it appears, without entries as an empty list.
    """
    kept = entries if threshold is None else entries.filter(F.col("val") > threshold)
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.col("col").cast("int"))).alias("indices"))
    if rows is None:
        return lists
    every = entries.sparkSession.range(rows).select(F.col("id").alias("row"))
    return every.join(lists, "row", "left").withColumn("indices", F.coalesce("indices", F.array().cast("array<int>")))


#: Rows of a sparse matrix that one task takes from a raw file.
SPARSE_ROWS = 1 << 20
_ENTRY = "row long, col long, val double"


def _entries(first: int, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the entries of CSR parts, some at a time; first: number of the first row."""
    row = np.repeat(np.arange(first, first + len(indptr) - 1), np.diff(indptr))
    for a in range(0, len(row), 100_000):
        columns = row[a : a + 100_000], np.asarray(indices[a : a + 100_000], np.int64), np.asarray(data[a : a + 100_000], float)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "col", "val"])


def read_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """Entries (row, col, val) and shape of a sparse matrix: .npz (CSR parts), .npy (a pickled matrix or
    a dense array), .mtx (MatrixMarket) or raw CSR (.spmat: int64 rows, columns, entries; int64 pointers; int32 columns; float32 values).

    A .mtx file is read in parallel by lines, a raw one by ranges of rows, the other kinds by a task each; no matrix comes to the driver.
    A pickle runs code when it is loaded: read only files of one's own.
    """
    if path.endswith(".mtx"):
        lines = spark.read.text(path).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
        head = lines.first().value.split()
        parts = F.split(F.trim("value"), r"\s+")
        body = lines.filter(F.trim("value") != " ".join(head)) if len(head) == 3 else lines
        entries = body.select((parts[0].cast("long") - 1).alias("row"), (parts[1].cast("long") - 1).alias("col"), F.coalesce(F.try_element_at(parts, F.lit(3)).cast("double"), F.lit(1.0)).alias("val"))
        return entries, (int(head[0]), int(head[1]))
    kind = path.rsplit(".", 1)[-1]
    whole = spark.read.format("binaryFile").load(path).select("content")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = parse_sparse(content.as_buffer(), kind)[0]
                yield pa.RecordBatch.from_arrays([pa.array([int(n)]) for n in found], ["rows", "columns"])

    def whole_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _entries(0, *parse_sparse(content.as_buffer(), kind)[1])

    def some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, (indptr, indices, data) = parse_sparse(content.as_buffer(), kind)
                own = indptr[first : first + SPARSE_ROWS + 1]
                yield from _entries(first, own - own[0], indices[own[0] : own[-1]], data[own[0] : own[-1]])

    rows, columns = whole.mapInArrow(shape, "rows long, columns long").first()
    if kind in ("npz", "npy", "pkl"):
        return whole.mapInArrow(whole_matrix, _ENTRY), (rows, columns)
    parts = max(1, -(-rows // SPARSE_ROWS))
    firsts = spark.range(0, parts, 1, parts).select((F.col("id") * SPARSE_ROWS).alias("first"))
    return firsts.join(F.broadcast(whole)).mapInArrow(some_rows, _ENTRY), (rows, columns)


def parse_sparse(content: bytes | pa.Buffer, kind: str) -> tuple[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shape, and row pointers, columns and values."""
    if kind == "npz":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            part = {n[:-4]: np.load(io.BytesIO(z.read(n)), allow_pickle=False) for n in z.namelist()}
        return tuple(int(x) for x in part["shape"]), (part["indptr"], part["indices"], part["data"])
    if kind == "npy":
        matrix = np.load(io.BytesIO(content), allow_pickle=True)
        return _csr(matrix.item() if matrix.dtype == object and matrix.ndim == 0 else matrix)
    if kind == "pkl":
        return _csr(pickle.loads(bytes(content)))
    rows, columns, n = (int(x) for x in np.frombuffer(content, "<i8", 3))
    at = 24 + 8 * (rows + 1)
    return (rows, columns), (np.frombuffer(content, "<i8", rows + 1, 24), np.frombuffer(content, "<i4", n, at), np.frombuffer(content, "<f4", n, at + 4 * n))


def _csr(matrix) -> tuple[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if hasattr(matrix, "tocsr"):
        matrix = matrix.tocsr()
        return matrix.shape, (matrix.indptr, matrix.indices, matrix.data)
    if isinstance(matrix, dict):
        return tuple(matrix["shape"]), (matrix["indptr"], matrix["indices"], matrix["data"])
    row, column = np.nonzero(matrix)
    return matrix.shape, (np.searchsorted(row, np.arange(matrix.shape[0] + 1)), column, matrix[row, column])


def write_lists(lists: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Lists as JSON lines, tab-separated (row, comma-joined) lines, or one JSON array of arrays (small results)."""
    if kind == "jsonl":
        lists.select(F.to_json("indices").alias("value")).write.mode("overwrite").text(path)
    elif kind == "tsv":
        lists.select(F.concat_ws("\t", F.col("row").cast("string"), F.array_join(F.col("indices").cast("array<string>"), ",")).alias("value")).write.mode("overwrite").text(path)
    elif kind == "json":
        with open(path, "w") as out:
            json.dump([list(r.indices) for r in lists.orderBy("row").toLocalIterator()], out)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def save_table(df: DataFrame, name: str, path: str | None = None, mode: str = "overwrite") -> None:
    """A bulk load: as a catalog table, or as Parquet at a path."""
    df.write.mode(mode).parquet(path) if path else df.write.mode(mode).saveAsTable(name)
