"""Toxicity by a convolutional text classifier, trained with numpy.

Words are hashed to embeddings; filters of several widths slide over them, the maximum of each
over the text goes to a logistic output. A word's embedding is the sum of those of the word and of
its beginnings, so that inflected forms share what was learned of their stem. A language guess from the text's own letters and words picks a threshold, and the
score is shifted so that the threshold lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches
from .training import fold, labelled_sample
from .words import Words, row_chunks, text_buffer, words

#: Labelled documents of either class to learn from, at most.
ROWS_PER_CLASS = 2000

BUCKETS = 1 << 14
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
STEP = 0.1
#: Steps at least; few texts are gone through more often.
STEPS = 400
#: Bytes of a word's beginnings that have embeddings of their own.
PREFIXES = (4, 5)

#: Frequent words that tell languages apart; the guess is the language with most of them.
GUESS_WORDS = {
    "de": "der die das und ist nicht ein eine von den zu mit auch für",
    "en": "the of and to in that is for are with this",
    "es": "el los las una por para como más con del que",
    "fr": "le les des une est pour dans pas que les en du au",
}
LANGUAGES = ("", *sorted(GUESS_WORDS))


@lru_cache(maxsize=1)
def _hash_table() -> tuple[np.ndarray, np.ndarray]:
    hashes, langs = [], []
    for n, lang in enumerate(LANGUAGES[1:]):
        data, offsets = text_buffer(pa.array([GUESS_WORDS[lang]]))
        h = np.unique(words(data, offsets).hashes)
        hashes.append(h)
        langs.append(np.full(len(h), n))
    order = np.argsort(h := np.concatenate(hashes))
    return h[order], np.concatenate(langs)[order]


def guess_language(found: Words) -> np.ndarray:
    """Index in LANGUAGES for each text, 0 where nothing tells."""
    table, langs = _hash_table()
    votes = np.zeros((len(found.bounds) - 1, len(LANGUAGES) - 1))
    low, high = np.searchsorted(table, found.hashes), np.searchsorted(table, found.hashes, "right")
    rows = found.rows
    for k in range(2):  # a word may stand in two lists
        at = np.flatnonzero(low + k < high)
        np.add.at(votes, (rows[at], langs[low[at] + k]), 1)
    return np.where(votes.max(1, initial=0) > 0, votes.argmax(1) + 1, 0)


@dataclass
class Model:
    """embeddings: buckets by dimensions, row 0 (zeros) for nothing; filters: width -> (width, dimensions, filters)."""

    embeddings: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    output: np.ndarray
    offset: float
    shifts: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def looked_up(self, found: Words) -> list[np.ndarray]:
        """Rows of the embeddings that sum up to a word's: of the word and of its beginnings."""
        row = lambda h: (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        return [row(found.hashes), *(np.where(h > 0, row(h), 0) for h in found.prefixes)]

    def responses(self, found: Words, width: int, sums: np.ndarray) -> np.ndarray:
        """Of the filters of a width at each word; words after the end of the text are zeros."""
        left = np.repeat(found.bounds[1:], found.counts) - np.arange(len(sums))
        reply = sums @ self.filters[width][0]
        for k in range(1, width):
            part = sums[k:] @ self.filters[width][k]
            part[left[:-k] <= k] = 0
            reply[:-k] += part
        return reply + self.biases[width]

    def word_sums(self, found: Words) -> np.ndarray:
        first, *more = self.looked_up(found)
        sums = np.take(self.embeddings, first, 0)
        for ids in more:
            sums += np.take(self.embeddings, ids, 0)
        return sums

    def pooled(self, found: Words) -> np.ndarray:
        """The largest response of each filter in each text, at least 0 (so also in an empty text)."""
        out = np.zeros((len(found.bounds) - 1, FILTERS * len(WIDTHS)), np.float32)
        full = np.flatnonzero(found.counts)
        if len(full):
            sums = self.word_sums(found)
            for n, w in enumerate(WIDTHS):
                top = np.maximum.reduceat(self.responses(found, w, sums), found.bounds[full], axis=0)
                out[full, n * FILTERS : (n + 1) * FILTERS] = np.maximum(top, 0)
        return out

    def logits(self, found: Words) -> np.ndarray:
        return self.pooled(found).astype(float) @ self.output + self.offset

    def score(self, found: Words) -> np.ndarray:
        z = self.logits(found) - self.shifts[guess_language(found)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fresh(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS))  # small: words never trained stay near nothing
    e[0] = 0
    filters = {w: rng.normal(0, 0.5 / w, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    return Model(e, filters, {w: np.zeros(FILTERS) for w in WIDTHS}, rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0)


def _step(model: Model, state: dict, found: Words, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One Adagrad step on a batch: only the position that gave a filter's maximum gets a gradient."""
    looked, sums = model.looked_up(found), model.word_sums(found)
    full = np.flatnonzero(found.counts)
    pooled = np.zeros((len(y), FILTERS * len(WIDTHS)))
    winners = {}
    for n, w in enumerate(WIDTHS):
        reply = model.responses(found, w, sums)
        best = np.full((len(y), FILTERS), -1)
        for i in full:
            a, b = found.bounds[i], found.bounds[i + 1]
            best[i] = a + reply[a:b].argmax(0)
        top = np.where(best >= 0, reply[best, np.arange(FILTERS)], 0) if len(reply) else np.zeros((len(y), FILTERS))
        pooled[:, n * FILTERS : (n + 1) * FILTERS] = np.maximum(top, 0)
        winners[w] = (best, top > 0)
    z = pooled @ model.output + model.offset
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)

    def update(name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        state[name] = state.get(name, np.full(value.shape, 1e-8)) + gradient**2
        value -= rate * gradient / np.sqrt(state[name])

    back = error[:, None] * model.output
    change_e = np.zeros_like(model.embeddings)
    for n, w in enumerate(WIDTHS):
        best, on = winners[w]
        i, f = np.nonzero(on)
        g, place = back[i, n * FILTERS + f], best[i, f]
        change = np.zeros_like(model.filters[w])
        for k in range(w):
            inside = place + k < found.bounds[i + 1]
            p, gk, fk = place[inside] + k, g[inside, None], f[inside]
            for ids in looked:
                np.add.at(change_e, ids[p], gk * model.filters[w][k][:, fk].T)
            np.add.at(change[k].T, fk, gk * sums[p])
        update(f"f{w}", model.filters[w], change)
        update(f"b{w}", model.biases[w], np.bincount(f, g, FILTERS))
    update("o", model.output, pooled.T @ error)
    offset = np.array([model.offset])
    update("c", offset, np.array([error.sum()]))
    model.offset = float(offset[0])
    change_e[0] = 0
    update("e", model.embeddings, change_e)


def _of(texts: Sequence[str]) -> Words:
    return words(*text_buffer(pa.array(list(texts), pa.large_string())), prefixes=PREFIXES)


def train(rows: Sequence[tuple[str, int]], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """From (text, label) pairs, both classes weighing as much; every fifth pair only calibrates.

    A language's threshold is the logit that makes fewest weighted errors among its calibration
    texts, pulled to the overall one where these are few. Without both labels all scores are that
    of the only label (0.5 without any).
    """
    model = _fresh(seed)
    labels = np.array([label for _, label in rows], float)
    if len(set(labels)) < 2:
        model.output[:] = 0
        model.offset = {0: -40.0, 1: 40.0}.get(int(labels[0]), 0.0) if len(labels) else 0.0
        return model
    tune = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    learn = np.flatnonzero(~tune)
    share = labels[learn].mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    rng, state = np.random.default_rng(seed), {}
    epochs = max(epochs, STEPS * 64 // len(learn))
    for epoch in range(epochs):
        order = rng.permutation(learn)
        for i in range(0, len(order), 64):
            own = order[i : i + 64]
            _step(model, state, _of([rows[j][0] for j in own]), labels[own], weight[own], STEP * (1 - epoch / epochs))
    model.embeddings = model.embeddings.astype(np.float32)
    model.filters = {w: f.astype(np.float32) for w, f in model.filters.items()}
    model.biases = {w: b.astype(np.float32) for w, b in model.biases.items()}
    held = np.flatnonzero(tune) if tune.any() else learn
    found = _of([rows[j][0] for j in held])
    z, langs = model.logits(found), guess_language(found)
    overall = _threshold(z, labels[held], 0.0)
    model.shifts = np.array([_threshold(z[langs == n], labels[held][langs == n], overall) for n in range(len(LANGUAGES))])
    return model


def _threshold(z: np.ndarray, y: np.ndarray, otherwise: float, least: int = 40) -> float:
    if len(z) < least or y.min() == y.max():
        return otherwise
    order = np.argsort(z)
    z, y = z[order], y[order]
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    missed = np.concatenate([[0], np.cumsum(y)]) / y.sum()
    wrong = (len(y) - y.sum() - np.concatenate([[0], np.cumsum(1 - y)])) / (1 - y).sum()
    cost = missed + wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    near = cuts[best]
    return float(near[np.abs(near - np.median(near)).argmin()])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    return train(labelled_sample(docs, labels, "toxic", rows_per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``: the probability that the text is toxic.

    Only the text is used, whole, however long; a null text is empty and scores as one without any word, null ids
    stay. Equal texts, of repeated rows too, get equal scores; an empty table stays empty. Other
    columns stay (a column ``score`` is replaced). One pass without a shuffle; the model has a
    fixed size and goes out once as a broadcast variable.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            out = [np.zeros(0)]
            for a, b in row_chunks(offsets):
                own = offsets[a : b + 1]
                out.append(shared.value.score(words(data[own[0] : own[-1]], own - own[0], prefixes=PREFIXES)))
            yield batch.append_column("score", pa.array(np.concatenate(out), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
