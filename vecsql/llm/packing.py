"""Conflict-constrained best-fit packing of texts into training sequences.

Texts are cut into pieces of at most ``capacity`` words. The pieces are dealt by a hash into shards
of a fixed expected size, each packed by itself, largest piece first; repeated rows go to different shards. Open bins are ordered by
what is left in them. A bin carries a bitmap of its sources (``per_source`` bits each) and one of its
duplicate clusters; the search starts at the tightest bin that holds the piece and goes on to the
next until one has room for the source and none of the cluster; if none has, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches
from .words import NON_SPACE, row_chunks, text_buffer, words

CAPACITY = 2048
#: Pieces of one source that a bin takes, at most.
PER_SOURCE = 4
#: Text of a shard, about: what a task holds at once.
SHARD_BYTES = 6 << 20


def best_fit(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each piece, in the order given; bins are numbered as they open."""
    number_s = {s: n for n, s in enumerate(dict.fromkeys(sources))}
    number_c = {c: n for n, c in enumerate(dict.fromkeys(clusters))}
    every = (1 << per_source) - 1
    open_: list[tuple[int, int]] = []  # (left, bin)
    held_s: list[int] = []
    held_c: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = number_s[source] * per_source, number_c[cluster]
        at = bisect_left(open_, (size, -1))
        while at < len(open_):
            n = open_[at][1]
            if held_s[n] >> s & every != every and not held_c[n] >> c & 1:
                break
            at += 1
        if at < len(open_):
            left, n = open_.pop(at)
        else:
            left, n = capacity, len(held_s)
            held_s.append(0)
            held_c.append(0)
        mine = held_s[n] >> s & every
        held_s[n] |= (mine + 1) << s  # 0, 1, 11, 111: the next of the source's bits
        held_c[n] |= 1 << c
        if left > size or not size:
            insort(open_, (left - size, n))
        out.append(n)
    return out


def _cut(capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each text: they begin with a word and end before the next piece's, and make up the text.

    again: how often the task had the row before, so that a row that is repeated without end is dealt to all shards.
    """
    seen: Counter = Counter()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        again = []
        for key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "cluster")), strict=True):
            again.append(seen[key])
            seen[key] += 1
        data, offsets = text_buffer(column)
        for a, b in row_chunks(offsets):
            own = offsets[a : b + 1]
            text = data[own[0] : own[-1]]
            found = words(text, own - own[0], NON_SPACE)
            n = np.maximum(-(-found.counts // capacity), 1)
            row = np.repeat(np.arange(b - a), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = piece * capacity
            size = np.minimum(found.counts[row] - first, capacity)
            begin = (own[:-1] - own[0])[row]
            later = piece > 0
            begin[later] = found.starts[found.bounds[row[later]] + first[later]]
            ends = np.append(begin[1:], len(text))
            ends = np.where(np.append(row[1:] != row[:-1], True), (own[1:] - own[0])[row], ends)
            cut = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(np.append(begin, ends[-1:]).astype(np.int64)), pa.py_buffer(text.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).slice(a, b - a).take(pa.array(row)) for k, name in enumerate(batch.schema.names) if name != "text"),
                    *map(pa.array, (piece.astype(np.int32), first, size, np.array(again, np.int64)[a:b][row])),
                    cut.cast(pa.string()),
                ],
                [*(name for name in batch.schema.names if name != "text"), "piece", "first_word", "n_words", "again", "text"],
            )


def _pack(capacity: int, per_source: int, table: pa.Table) -> pa.Table:
    table = table.sort_by([("n_words", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
    sizes, sources, clusters = (table.column(c).to_pylist() for c in ("n_words", "source", "cluster"))
    bins = np.array(best_fit(sizes, sources, clusters, capacity, per_source), np.int64)
    order = np.argsort(bins, kind="stable")
    bins, sizes = bins[order], np.array(sizes, np.int64)[order]
    first = np.searchsorted(bins, bins)
    before = np.cumsum(sizes) - sizes
    table = table.take(pa.array(order))
    shard = table.column("shard").cast(pa.int64()).to_numpy()
    out = {
        "bin_id": pa.array((shard << 32) + bins),
        "slot": pa.array((np.arange(len(bins)) - first).astype(np.int32)),
        "position": pa.array(before - before[first]),
    }
    out |= {name: table.column(name) for name in table.column_names if name not in ("shard", "cluster", "again")}
    return pa.table(out)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, with_text: bool = True, shard_bytes: int = SHARD_BYTES, cluster: str | None = None
) -> DataFrame:
    """One row a piece: bin_id, slot and position (in words) in the bin, doc_id, source, piece, first_word, n_words (and text).

    Every text is packed whole. A null text is empty; an empty text is one piece of no words. A
    null source is a source of its own. Equal texts are one duplicate cluster, or the rows of equal values of the column
    ``cluster`` if it is named (a class of near-duplicates, say; a null is the cluster of its text); its members never share a
    bin, nor do the pieces of one text. Repeated rows are packed each. Very long texts give as many pieces as they need; ties of size go by
    cluster, id and piece. Only these columns are read, null ids stay, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(1, ceil(total / shard_bytes))
    own = F.xxhash64(text) if cluster is None else F.when(F.col(cluster).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.lit("cluster"), cluster))
    whole = docs.select("doc_id", "source", own.alias("cluster"), text.alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in whole.schema}
    own = f"doc_id {kind['doc_id']}, source {kind['source']}, cluster long, piece int, first_word long, n_words long, again long, text string"
    pieces = whole.mapInArrow(lambda batches: _cut(capacity, batches), own)
    pieces = pieces if with_text else pieces.drop("text")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece", "again"), F.lit(shards)).cast("int"))
    result = f"bin_id long, slot int, position long, {own.replace('cluster long, ', '').replace('again long, ', '')}"
    if not with_text:
        result = result.replace(", text string", "")
    return dealt.groupBy("shard").applyInArrow(lambda table: _pack(capacity, per_source, table), result)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, words in them, and the share of all bins' capacity that these take."""
    whole = packed.agg(F.countDistinct("bin_id").alias("bins"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    return whole.withColumn("fill", F.col("words") / F.greatest(F.col("bins") * capacity, F.lit(1)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, with_text=False)
