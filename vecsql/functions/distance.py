"""Distances between vector columns, as Catalyst expressions.

Each function takes two array columns, or one and a constant (a Python sequence), and computes in
double. A NULL vector or element gives NULL; vectors of different lengths raise an error when the
row is evaluated. Higher-order functions stay on the JVM, where a constant of any length is one
literal array; ``batch_distances`` is the numpy form for many constants at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str | Sequence[float]


def vector(v: Vector, kind: str = "double") -> Column:
    """An array column of doubles, from a column, its name or a constant."""
    if isinstance(v, str):
        return F.col(v).cast(f"array<{kind}>")
    if isinstance(v, Column):
        return v.cast(f"array<{kind}>")
    return F.array(*[F.lit(float(x)) for x in v]).cast(f"array<{kind}>")


def _total(terms: Column, zero: str = "double") -> Column:
    return F.aggregate(terms, F.lit(0).cast(zero), lambda s, x: s + x)


def _pairwise(a: Vector, b: Vector, term: Callable[[Column, Column], Column], kind: str = "double") -> Column:
    """The sum over positions; unequal lengths are an error, as ``zip_with`` would pad with NULL."""
    x, y = vector(a, kind), vector(b, kind)
    same = F.size(x) == F.size(y)
    message = F.format_string("vectors have different dimensions: %d and %d", F.size(x), F.size(y))
    checked = F.when(x.isNull() | y.isNull() | same, F.zip_with(x, y, term)).otherwise(F.raise_error(message).cast(f"array<{kind}>"))
    return _total(checked, kind)


def l2sq(a: Vector, b: Vector) -> Column:
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(l2sq(a, b))


def inner_product(a: Vector, b: Vector) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def negative_inner_product(a: Vector, b: Vector) -> Column:
    return -inner_product(a, b)


def ip(a: Vector, b: Vector) -> Column:
    """The index metric: one minus the inner product."""
    return F.lit(1.0) - inner_product(a, b)


def _norm_sq(a: Vector) -> Column:
    return _total(F.transform(vector(a), lambda x: x * x))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """Of a zero vector and another 0; of two zero vectors 1."""
    dot, p, q = inner_product(a, b), _norm_sq(a), _norm_sq(b)
    return F.when(p.isNull() | q.isNull(), F.lit(None).cast("double")).when((p == 0) & (q == 0), F.lit(1.0)).when((p == 0) | (q == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(p) * F.sqrt(q)))


def cosine_distance(a: Vector, b: Vector) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def l1(a: Vector, b: Vector) -> Column:
    return _pairwise(a, b, lambda x, y: F.abs(x - y))


def _bits(a: Vector, b: Vector, both: Callable[[Column, Column], Column]) -> Column:
    return _pairwise(a, b, lambda x, y: F.bit_count(both(x, y)).cast("long"), "long")


def hamming(a: Vector, b: Vector) -> Column:
    """Different bits of two arrays of integer words."""
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y))


def tanimoto(a: Vector, b: Vector) -> Column:
    """1 - common / all set bits; two empty sets are at distance 0."""
    union = _bits(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - _bits(a, b, lambda x, y: x.bitwiseAND(y)) / union)


def sorensen(a: Vector, b: Vector) -> Column:
    """1 - 2 common / (set bits of the first + of the second)."""
    total = _bits(a, a, lambda x, _: x) + _bits(b, b, lambda x, _: x)
    return F.when(total == 0, F.lit(0.0)).otherwise(1 - 2 * _bits(a, b, lambda x, y: x.bitwiseAND(y)) / total)


def jaccard(a: Vector, b: Vector) -> Column:
    """Of two sets of ids."""
    x, y = vector(a, "long"), vector(b, "long")
    union = F.size(F.array_union(x, y))
    empty = F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(union == 0, F.lit(0.0))
    return empty.otherwise(1 - F.size(F.array_intersect(x, y)) / union)


def pearson(a: Vector, b: Vector) -> Column:
    """1 - correlation; 0 for one dimension or a constant vector."""
    n = F.size(vector(a)).cast("double")
    total = lambda v: _total(vector(v))
    top = n * inner_product(a, b) - total(a) * total(b)
    below = (n * _norm_sq(a) - total(a) * total(a)) * (n * _norm_sq(b) - total(b) * total(b))
    return F.when((n <= 1) | (below <= 0), F.lit(0.0)).otherwise(1 - top / F.sqrt(below))


#: Added to probabilities before their logarithm is taken.
EPSILON = 1e-9


def kullback_leibler(a: Vector, b: Vector) -> Column:
    return _pairwise(a, b, lambda p, q: p * F.ln((p + EPSILON) / (q + EPSILON)))


def jensen_shannon(a: Vector, b: Vector) -> Column:
    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2 + EPSILON
        return (p * F.ln((p + EPSILON) / m) + q * F.ln((q + EPSILON) / m)) / 2

    return _pairwise(a, b, term)


def haversine(a: Vector, b: Vector) -> Column:
    """Great-circle distance on the unit sphere of (latitude, longitude) in degrees."""
    x, y = vector(a), vector(b)
    lat = F.radians(y[0] - x[0])
    lon = F.radians(y[1] - x[1])
    h = F.pow(F.sin(lat / 2), 2) + F.cos(F.radians(x[0])) * F.cos(F.radians(y[0])) * F.pow(F.sin(lon / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def quantize_i8(a: Vector) -> Column:
    """Components of [-1, 1] as integers of [-100, 100]."""
    return F.transform(vector(a), lambda x: F.greatest(F.least(F.round(x * 100), F.lit(100.0)), F.lit(-100.0)).cast("tinyint"))


def l2sq_i8(a: Vector, b: Vector) -> Column:
    return _pairwise(a, b, lambda x, y: (x - y) * (x - y), "int")


def cosine_i8(a: Vector, b: Vector) -> Column:
    """Cosine distance in integers; 0 where the inner product is 0."""
    dot = _pairwise(a, b, lambda x, y: x * y, "int")
    p, q = (_total(F.transform(vector(v, "int"), lambda x: x * x), "int") for v in (a, b))
    return F.when(dot == 0, F.lit(0.0)).otherwise(1 - dot / (F.sqrt(p.cast("double")) * F.sqrt(q.cast("double"))))


def to_f16(a: Vector) -> Column:
    """Each number as half precision holds it: 11 bits, ties to even, infinite from 65,520 on."""

    def one(x: Column) -> Column:
        size = F.abs(x)
        rough = F.floor(F.log2(size))
        power = F.when(F.pow(F.lit(2.0), rough + 1) <= size, rough + 1).when(F.pow(F.lit(2.0), rough) > size, rough - 1).otherwise(rough)
        step = F.pow(F.lit(2.0), F.greatest(power, F.lit(-14)) - 10)
        near = F.rint(x / step) * step
        return F.when((size == 0) | F.isnan(x) | (size == float("inf")), x).when(size >= 65520, F.signum(x) * float("inf")).otherwise(near)

    return F.transform(vector(a), one).cast("array<float>")


def to_bits(a: Vector) -> Column:
    """64-bit words in which a bit says whether a component is positive, the first component lowest."""
    v = vector(a)
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / 64) - 1, F.lit(0)).cast("int"))

    def word(n: Column) -> Column:
        part = F.transform(F.slice(v, n * 64 + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.when(F.size(v) > 0, F.transform(words, word)).otherwise(F.array().cast("array<bigint>"))


#: By name: the SQL functions and operators, and the measures beyond them.
DISTANCES: dict[str, Callable[[Vector, Vector], Column]] = {
    "array_distance": euclidean,
    "array_cosine_distance": cosine_distance,
    "array_cosine_similarity": cosine_similarity,
    "array_inner_product": inner_product,
    "array_negative_inner_product": negative_inner_product,
    "l2sq": l2sq,
    "ip": ip,
    "l1": l1,
    "hamming": hamming,
    "tanimoto": tanimoto,
    "sorensen": sorensen,
    "jaccard": jaccard,
    "pearson": pearson,
    "kullback_leibler": kullback_leibler,
    "jensen_shannon": jensen_shannon,
    "haversine": haversine,
    "l2sq_i8": l2sq_i8,
    "cosine_i8": cosine_i8,
}

#: SQL operators by name of the function they stand for.
OPERATORS = {"<->": "array_distance", "<=>": "array_cosine_distance", "<#>": "array_negative_inner_product", "<+>": "l1"}

#: Index metrics and the function whose order each serves.
METRICS = {"l2sq": "array_distance", "cosine": "array_cosine_distance", "ip": "array_negative_inner_product"}


def register(name: str, build: Callable[[Vector, Vector], Column]) -> None:
    """A measure of one's own, from two vectors to a column."""
    if name in DISTANCES:
        raise ValueError(f"distance {name!r} is known already")
    DISTANCES[name] = build


def distance(name: str, a: Vector, b: Vector) -> Column:
    name = OPERATORS.get(name, name)
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}; known are {', '.join(sorted(DISTANCES))}")
    return DISTANCES[name](a, b)


def metric_of(function: str) -> str:
    """The index metric that serves a function's order."""
    name = OPERATORS.get(function, function)
    for metric, served in METRICS.items():
        if served == name or metric == name or (metric, name) == ("cosine", "array_cosine_similarity"):
            return metric
    raise ValueError(f"no index metric serves {function!r}")


def batch_distances(name: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(queries, vectors) in double, for the functions that the metrics serve."""
    name = METRICS.get(OPERATORS.get(name, name), OPERATORS.get(name, name))
    q, v = np.asarray(queries, np.float64), np.asarray(vectors, np.float64)
    dot = q @ v.T
    if name == "array_negative_inner_product":
        return -dot
    p, r = (q * q).sum(1)[:, None], (v * v).sum(1)[None]
    if name == "array_distance":
        return np.sqrt(np.maximum(p + r - 2 * dot, 0))
    if name == "array_cosine_distance":
        with np.errstate(divide="ignore", invalid="ignore"):
            similarity = dot / (np.sqrt(p) * np.sqrt(r))
        return 1 - np.where((p == 0) & (r == 0), 1.0, np.where((p == 0) | (r == 0), 0.0, similarity))
    raise ValueError(f"no batch form of {name!r}")


#: From so many dimensions on a scan computes distances in Arrow batches: the JVM interprets a lambda for each component.
ARROW_DIMENSIONS = 16


def _rows(name: str, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of the rows of a matrix to one vector, each row by itself: equal rows get equal ones."""
    if name in ("array_distance", "l2sq", "l1"):
        d = m - q
        return np.abs(d).sum(1) if name == "l1" else (np.sqrt((d * d).sum(1)) if name == "array_distance" else (d * d).sum(1))
    dot = (m * q).sum(1)
    if name in ("array_inner_product", "array_negative_inner_product", "ip"):
        return {"array_inner_product": dot, "array_negative_inner_product": -dot, "ip": 1 - dot}[name]
    p, r = np.sqrt((m * m).sum(1)), np.sqrt((q * q).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        similarity = np.where((p == 0) & (r == 0), 1.0, np.where((p == 0) | (r == 0), 0.0, dot / (p * r)))
    return similarity if name == "array_cosine_similarity" else 1 - similarity


def scan(name: str, column: str | Column, query: Sequence[float]) -> Column:
    """``distance`` to a constant for a scan of many rows: in Arrow batches where that is faster, with the same NULLs and errors."""
    known = OPERATORS.get(name, name)
    if len(query) < ARROW_DIMENSIONS or known not in ("array_distance", "l2sq", "l1", "array_inner_product", "array_negative_inner_product", "ip", "array_cosine_similarity", "array_cosine_distance"):
        return distance(name, column, query)
    q = np.asarray(query, np.float64)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        lengths = np.diff(vectors.offsets.to_numpy())
        real = vectors.is_valid().to_numpy(zero_copy_only=False)
        if (lengths[real] != len(q)).any():
            raise ValueError(f"vectors have different dimensions: {lengths[real & (lengths != len(q))][0]} and {len(q)}")
        flat = vectors.flatten()  # without the null rows
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
        out = np.full(len(vectors), np.nan)
        out[real] = _rows(known, m, q)
        none = ~real
        if flat.null_count:
            none[np.flatnonzero(real)[flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(q)).any(1)]] = True
        return pa.array(out, mask=none)

    return run(F.col(column) if isinstance(column, str) else column)
