"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is cut into
blocks, each is compressed with either dictionary, and the difference of the summed sizes, over
the text's length, says which kind of text it shares more with. Blocks keep the dictionary's part
from fading in long texts, and a text that repeats itself compresses well with both, so that its
difference is near 0, unlike that of clean prose. A logistic curve fitted on texts that went into
neither dictionary turns the difference into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches
from .training import fold, label_counts, labelled_sample

#: Documents of either label that the dictionaries and the curve are made from, at most.
ROWS_PER_CLASS = 1500

BLOCK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Bytes added to a text's length, so that a few bytes' difference in a short text weigh little.
PRIOR_BYTES = 40


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def _dictionary(texts: Sequence[bytes]) -> bytes:
    """Trained; of too little text for that, the text itself."""
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0
    scale: float = 1.0
    _pair: tuple = field(default=(), repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_pair": ()}

    def _compressors(self):
        if not self._pair:
            quiet = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            kind = lambda d: zstandard.ZstdCompressionDict(d) if d else None
            self._pair = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=kind(d), **quiet) for d in (self.good, self.bad))
        return self._pair

    def difference(self, text: bytes) -> float:
        """Positive where the good dictionary makes the text smaller."""
        good, bad = self._compressors()
        saved = sum(len(bad.compress(b)) - len(good.compress(b)) for b in _blocks(text))
        return saved / (len(text) + PRIOR_BYTES)

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences / self.scale + self.offset, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights of [x, 1] by Newton's method, both classes weighing as they occur."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: Sequence[tuple[str, int]], counts: dict[int, int] | None = None) -> Model:
    """From (text, label) pairs; even ones make the dictionaries, odd ones the curve.

    counts: of all labels, where the pairs are a sample of each class; the curve then gives the
    probability at those shares instead of the sample's.
    Without both labels there is nothing to tell apart, and every score is 1 or 0 by the only label
    (0.5 without any).
    """
    by = {k: [t.encode("utf-8", "surrogatepass") for t, label in rows if label == k] for k in (0, 1)}
    if len(by[0]) < 2 or len(by[1]) < 2:
        sure = {(True, False): -40.0, (False, True): 40.0}.get((bool(by[0]), bool(by[1])), 0.0)
        return Model(b"", b"", offset=sure)
    model = Model(_dictionary(by[1][::2]), _dictionary(by[0][::2]))
    x = np.array([model.difference(t) for k in (0, 1) for t in by[k][1::2]])
    y = np.array([k for k in (0, 1) for _ in by[k][1::2]], float)
    model.scale = float(x.std()) or 1.0
    model.slope, model.offset = fit_logistic(x / model.scale, y)
    if counts and counts[0] and counts[1]:
        model.offset += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    return train(labelled_sample(docs, labels, "quality", rows_per_class), label_counts(labels, "quality"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``: the probability that the text is good.

    Only the text is used, whole, however long; a null text is empty, null ids stay. Equal texts, of repeated rows
    too, get equal scores; an empty table stays empty. Other columns stay (a column ``score`` is
    replaced). One pass without a shuffle. The model, two dictionaries of fixed size, goes out once
    as a broadcast variable.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).cast(pa.large_binary())
            found = np.array([shared.value.difference(t.as_py() or b"") for t in texts], float)
            yield batch.append_column("score", pa.array(shared.value.score(found), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


#: A document is kept from this score on.
THRESHOLD = 0.3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
