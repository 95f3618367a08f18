"""Near-duplicate texts by ProbMinHash, banding and verification.

The shingles of a text are its runs of five words, weighted by how often they occur. Each shingle
is a Poisson process whose rate is its weight: arrivals come at sums of exponential times, drawn
from the shingle's hash, and each arrival picks a register. A register keeps the shingle of its
earliest arrival. A shingle stops as soon as its next arrival is later than the latest register's
time, so after the first arrivals only few go on. Two texts agree in a register with the
probability Jaccard similarity of their weights. All texts of a batch are run together in numpy.

One similarity serves throughout, the probability Jaccard similarity of the counts of shingles:

    J(x, y) = sum over common d of 1 / sum over all e of max(x[e] / x[d], y[e] / y[d])

It is that of the two distributions, whatever the lengths of the texts, and the usual Jaccard similarity of the sets
where no shingle is repeated. Bands of registers make buckets; see ``linking`` for how they are
compared. A link is verified by J itself over the shingles, hashed to 32 bits (two different shingles of a pair
of texts of 1,000 words meet by chance once in 4,000 pairs, which moves a similarity by 0.0005).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linking import linked_groups
from .scratch import Scratch, small_batches, unused
from .words import mix, ngrams, row_chunks, text_buffer, words

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 two texts share a band with probability 1 - (1 - 0.8 ** 5) ** 24 > 0.9999.
BANDS, ROWS = 24, 5
#: The bands take the first of them; all serve to estimate a similarity.
REGISTERS = 384
#: Four standard deviations below 0.8 of a similarity estimated from all registers: of the pairs at exactly 0.8, one in 31,000 is
#: estimated lower, against one in 14,000 that shares no band; of those at 0.82, one in three million.
LEAST_ESTIMATE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Bits that a register takes beside others.
LANE = 15
#: What rounding may take from a similarity.
SLACK = 1e-9
#: Up to so many keys (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 400_000

#: Of a bucket's members, what a block holds about, and what a member takes beside its shingles.
MEET_BYTES, MEMBER_BYTES = 4 << 20, 2048
#: Pairs whose registers are compared at once.
LISTED = 1 << 14

_GOLD = 0x9E3779B97F4A7C15


def signatures(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """(n_rows, registers) hashes of the winning elements; 0 all over for a row without elements."""
    times = np.full(n_rows * registers, np.inf)
    winner = np.zeros(n_rows * registers, np.uint64)
    elapsed = np.zeros(len(hashes))
    latest = np.full(n_rows, np.inf)
    n = 0
    while len(hashes):
        bits = mix(hashes + np.uint64(n * _GOLD & (1 << 64) - 1))
        elapsed = elapsed - np.log(((bits >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weights
        live = elapsed < latest[rows]
        hashes, rows, weights, elapsed, bits = (v[live] for v in (hashes, rows, weights, elapsed, bits))
        at = rows * registers + (mix(bits ^ np.uint64(_GOLD)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, at, elapsed)
        won = times[at] == elapsed
        winner[at[won]] = hashes[won]
        own = np.unique(rows)
        latest[own] = times.reshape(n_rows, registers)[own].max(1)
        n += 1
    return winner.reshape(n_rows, registers)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and count of the distinct shingles of each text, by row."""
    hashes, rows = ngrams(words(data, offsets), SHINGLE)
    _, first, counts = np.unique(hashes + mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    order = np.argsort(rows[first], kind="stable")
    first = first[order]
    return hashes[first], rows[first], counts[order].astype(float)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(column)
    for a, b in row_chunks(offsets):
        for c in range(a, b, 2048):
            own = offsets[c : min(c + 2048, b) + 1]
            yield c, min(c + 2048, b), data[own[0] : own[-1]], own - own[0]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, size, sign, bands): registers of 14 bits, four in a number, and a hash of each band; none without shingles."""
    for batch in batches:
        for a, b, data, offsets in _chunks(batch.column(2)):
            hashes, rows, counts = weighted_shingles(data, offsets)
            size = np.bincount(rows, minlength=b - a)
            full = np.flatnonzero(size)
            winner = signatures(hashes, rows, counts, b - a)[full]
            bands = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
            for k in range(ROWS):
                bands = mix(bands * np.uint64(_GOLD) + winner[:, k : BANDS * ROWS : ROWS])
            four = (winner >> np.uint64(50)).reshape(len(full), REGISTERS // 4, 4) << np.arange(0, 60, LANE, dtype=np.uint64)
            lists = []
            for x in (four.sum(2, dtype=np.uint64).view(np.int64), bands.view(np.int64)):
                bounds = np.zeros(b - a + 1, np.int32)
                bounds[full + 1] = x.shape[1]
                lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(bounds).astype(np.int32)), pa.array(x.ravel())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size.astype(np.int64)), *lists],
                ["doc_id", "text_key", "size", "sign", "bands"],
            )


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles, counts): as bytes, 32 bits each, the shingles in order."""
    for batch in batches:
        for a, b, data, offsets in _chunks(batch.column(1)):
            hashes, rows, counts = weighted_shingles(data, offsets)
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((short, rows))
            short, counts, rows = short[order], counts[order], rows[order]
            new = np.r_[True, (short[1:] != short[:-1]) | (rows[1:] != rows[:-1])] if len(rows) else np.zeros(0, bool)
            counts = np.add.reduceat(counts, np.flatnonzero(new)).astype(np.uint32) if len(rows) else counts.astype(np.uint32)
            short, bounds = short[new], np.searchsorted(rows[new], np.arange(b - a + 1)).tolist()
            blobs = [[x[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)] for x in (short, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, pa.binary()) for x in blobs)], ["node", "shingles", "counts"])


def probability_jaccard(shingles_a: np.ndarray, counts_a: np.ndarray, shingles_b: np.ndarray, counts_b: np.ndarray) -> float:
    """Of two bags: different shingles and their counts."""
    _, i, j = np.intersect1d(shingles_a, shingles_b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = counts_a[i].astype(float), counts_b[j].astype(float)
    rest_x, rest_y = counts_a.sum(dtype=float) - x.sum(), counts_b.sum(dtype=float) - y.sum()
    if x.max() == x.min() and y.max() == y.min():  # as most texts are
        return float(len(x) / (rest_x / x[0] + rest_y / y[0] + len(x)))
    # common shingles of the same two counts are alike
    (x, y), n = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    total = 0.0
    for a in range(0, len(x), 512):
        p, q = x[a : a + 512, None], y[a : a + 512, None]
        total += float((n[a : a + 512] / (rest_x / p[:, 0] + rest_y / q[:, 0] + (n * np.maximum(x / p, y / q)).sum(1))).sum())
    return total


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, *bags = (c.to_pylist() for c in batch.columns)
        found = [probability_jaccard(*(np.frombuffer(v, np.uint32) for v in four)) for four in zip(*bags, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.float64())], ["a", "b", "similarity"])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
_MEMBERS = pa.schema([("node", pa.int64()), ("bucket", pa.int64())])


def _meeting(least: float, similarity: float | None) -> Callable[[pa.Table], pa.Table]:
    """Compares the members of buckets that meet in a task: pairs of two components, one of them apart from its hub, in the first band that they share.

    Without a similarity: (node, bucket) of those with an estimate of ``least`` or more. With one, and shingles and counts: links. A pair is
    verified unless links found before in the task have joined both, so the links are fewer than the members.
    """

    def run(rows: pa.Table) -> pa.Table:
        node, bucket, root, apart, i, j, block = (rows.column(c).to_numpy() for c in ("node", "bucket", "root", "apart", "i", "j", "block"))
        order = np.lexsort((node, bucket))
        node, bucket, apart, block, across = node[order], bucket[order], apart[order], block[order], (i != j)[order]
        sign, bands = (np.concatenate([c.flatten().to_numpy() for c in rows.column(name).chunks]).reshape(len(rows), -1)[order] for name in ("sign", "bands"))
        registers = (sign[:, :, None] >> np.arange(0, 60, LANE) & (1 << 14) - 1).astype(np.uint16).reshape(len(rows), -1)
        joined = np.unique(root[order], return_inverse=True)[1]
        bags = [rows.column(c).take(pa.array(order)).to_pylist() for c in ("shingles", "counts")] if similarity is not None else None
        near, links = np.zeros(len(rows), bool), []

        def look(p: np.ndarray, q: np.ndarray) -> None:
            first = bands[p, (bands[p] == bands[q]).argmax(1)] == bucket[p]
            p, q = p[first], q[first]
            estimate = 1.0 - (registers[p] != registers[q]).sum(1) / REGISTERS
            p, q, estimate = (v[estimate >= least] for v in (p, q, estimate))
            near[p] = near[q] = True
            if bags is None:
                return
            for k in np.argsort(-estimate, kind="stable").tolist():
                a, b = int(p[k]), int(q[k])
                if joined[a] == joined[b]:
                    continue
                found = probability_jaccard(*(np.frombuffer(column[n], np.uint32) for n in (a, b) for column in bags))
                if found >= similarity - SLACK:
                    links.append((min(node[a], node[b]), max(node[a], node[b]), found))
                    joined[joined == max(joined[a], joined[b])] = min(joined[a], joined[b])

        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        end = np.repeat(np.r_[starts[1:], len(bucket)], np.diff(np.r_[starts, len(bucket)]))
        at, step, held, ps, qs = np.arange(len(node)), 1, 0, [], []
        while len(at):
            at = at[at + step < end[at]]
            p, q = at, at + step
            fresh = (joined[p] != joined[q]) & (apart[p] | apart[q]) & (~across[p] | (block[p] != block[q]))
            ps.append(p[fresh])
            qs.append(q[fresh])
            held, step = held + int(np.count_nonzero(fresh)), step + 1
            if held >= LISTED or not len(at):
                p, q = np.concatenate(ps), np.concatenate(qs)
                for n in range(0, len(p), LISTED):
                    look(p[n : n + LISTED], q[n : n + LISTED])
                held, ps, qs = 0, [], []
        if bags is None:
            return pa.table([node[near], bucket[near]], schema=_MEMBERS)
        return pa.table([pa.array(v, t) for v, t in zip(zip(*links, strict=True), _LINKS.types, strict=True)] if links else _LINKS.empty_table().columns, schema=_LINKS)

    return run


def _met(members: DataFrame, weight: Column, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``run`` finds among the members of each bucket. Small buckets share a task; a large one is dealt into blocks, each two of them in a task."""
    sizes = members.groupBy("bucket").agg(F.sum(weight).alias("bytes"))
    cells = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // MEET_BYTES))
    blocks = F.ceil(F.col("bytes") / MEET_BYTES).cast("int")
    sizes = sizes.select("bucket", blocks.alias("blocks"), F.when(blocks > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(cells))).alias("cell"))
    dealt = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return dealt.groupBy("cell", "i", "j").applyInArrow(run, schema)


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _estimate(a: str, b: str) -> Column:
    """The share of equal registers. Where two of 14 bits differ, ``(a ^ b) + 2 ** 14 - 1`` reaches the bit above them."""
    carry, top = (F.lit(sum(v << n for n in range(0, 60, LANE))) for v in ((1 << 14) - 1, 1 << 14))
    differ = F.zip_with(a, b, lambda p, q: F.bit_count((p.bitwiseXOR(q) + carry).bitwiseAND(top)))
    return F.lit(1.0) - F.aggregate(differ, F.lit(0), lambda s, v: s + v) / REGISTERS


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(doc_id, text)``: one row a document, and the links between different texts.

    First: doc_id, text_key, class_id (smallest doc_id of the group), copies (rows of the same text),
    kept (this id and text stand for the group). Second: (a, b, similarity) of smallest doc_ids.
    Equal texts, repeated rows among them, are one class and are compared once; very long texts are compared whole. A null
    text is empty; texts without words are alike only if equal. Null ids count as larger than all others. Only doc_id and
    text are read; an empty table gives empty ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", _key(F.col("text")).alias("text_key"), "text")
    rows = keyed.mapInArrow(_sign, f"doc_id {kind}, text_key string, size long, sign array<long>, bands array<long>")
    # of one text the size and registers are equal: any of them will do
    classes = rows.groupBy("text_key").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("size", "sign", "bands"))
    )
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    signed = classes.filter("size > 0")
    members = signed.select("node", F.explode("bands").alias("bucket"))

    least = LEAST_ESTIMATE - (SIMILARITY - similarity)

    def bags_of(nodes: DataFrame, name: str) -> DataFrame:
        wanted = scratch.save(nodes.join(classes, "node").select("node", F.col("text_key").alias("its_key"), F.col("least_id").alias("its_id")), f"{name}-texts")
        few = wanted.count() <= BROADCAST_KEYS
        on = (F.col("text_key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
        texts = keyed.join(F.broadcast(wanted) if few else wanted, on).select("node", "text")
        return scratch.save(texts.mapInArrow(_shingle_counts, "node long, shingles binary, counts binary").dropDuplicates(["node"]), f"{name}-bags")

    def verify(pairs: DataFrame, _: bool) -> DataFrame:
        signs = signed.select("node", "sign")
        pairs = pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b")
        pairs = scratch.save(pairs.filter(_estimate("sign_a", "sign_b") >= least).select("a", "b"), "pairs")
        bags = bags_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pairs")
        both = pairs.join(bags.toDF("a", "shingles_a", "counts_a"), "a").join(bags.toDF("b", "shingles_b", "counts_b"), "b")
        found = both.select("a", "b", "shingles_a", "counts_a", "shingles_b", "counts_b").mapInArrow(_verify, "a long, b long, similarity double")
        found = scratch.save(found.filter(F.col("similarity") >= similarity - SLACK), "pairs-links")
        scratch.drop("pairs", "pairs-texts", "pairs-bags")
        return found

    def meet(members: DataFrame) -> DataFrame:
        members = scratch.save(members, "open")
        signs = signed.select("node", "size", "sign", "bands")
        # first by estimates alone; shingles are fetched for those only that have a partner
        near = _met(members.join(signs, "node"), F.lit(MEMBER_BYTES), _meeting(least, None), "node long, bucket long")
        near = scratch.save(near.distinct(), "near")
        bags = bags_of(near.select("node").distinct(), "near")
        again = near.join(members, ["node", "bucket"]).join(signs, "node").join(bags, "node")
        found = scratch.save(_met(again, MEMBER_BYTES + 8 * F.col("size"), _meeting(least, similarity), "a long, b long, similarity double"), "near-links")
        scratch.drop("open", "near", "near-texts", "near-bags")
        return found

    links, roots = linked_groups(members, verify, None, scratch, meet)
    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = grouped.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "text_key")).alias("head"))
    grouped = grouped.join(heads, "root").select(
        F.col("text_key").alias("its_key"), "copies", F.col("head.least_id").alias("class_id"), F.col("head.text_key").alias("head_key")
    )
    out = docs.select("doc_id", _key(F.col("text")).alias("text_key")).join(grouped, F.col("text_key") == F.col("its_key"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("head_key"))
    ids = classes.select("node", "least_id")
    named = links.join(ids.toDF("a", "id_a"), "a").join(ids.toDF("b", "id_b"), "b")
    return (
        out.select("doc_id", "text_key", "class_id", "copies", kept.alias("kept")),
        named.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, all columns as they are.

    Rows that go are known by id and text. Where the row that stays is itself repeated, one of the
    repeated rows stays. A null text is empty, and all texts without characters are one group; null ids count as
    larger than all others; other columns may have any names. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup-rows")
    found, _ = groups(docs)
    its_id, its_key, its_kept, text_key = (unused(n, docs) for n in ("its_id", "its_key", "its_kept", "text_key"))
    # dealt anew, so that the join before may split the rows of a text that is repeated very often
    found = found.repartition("doc_id", "text_key")
    decided = found.groupBy(F.col("doc_id").alias(its_id), F.col("text_key").alias(its_key)).agg(F.first("kept").alias(its_kept), F.count("*").alias("n"))
    decided = scratch.save(decided.filter(~F.col(its_kept) | (F.col("n") > 1)).drop("n"), "decided")
    few = decided.count() <= BROADCAST_KEYS
    on = F.col("doc_id").eqNullSafe(F.col(its_id)) & (_key(F.col("text")) == F.col(its_key))
    again = decided.filter(its_kept)
    single = docs.join(F.broadcast(decided) if few else decided, on, "left_anti")
    if not again.take(1):
        return single
    repeated = docs.join(F.broadcast(again) if few else again, on, "left_semi").withColumn(text_key, _key(F.col("text")))
    return single.unionByName(repeated.dropDuplicates(["doc_id", text_key]).drop(text_key))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "copies", "kept")


#: The same rows in DuckDB for distinct ids: all texts that share a shingle are compared.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS node, count(*) AS copies FROM documents GROUP BY 1
), w AS (
  SELECT node, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), s AS (
  SELECT node, s, count(*)::DOUBLE AS c FROM (
    SELECT node, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
    FROM w WHERE len(w) > 0
  ) GROUP BY ALL
), n AS (
  SELECT node, sum(c) AS n FROM s GROUP BY node
), p AS (
  SELECT x.node AS a, y.node AS b, x.c AS cx, y.c AS cy, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.node <> y.node GROUP BY ALL
), c AS (
  SELECT a, b, sum(m * cx) AS x, sum(m * cy) AS y FROM p GROUP BY ALL
), q AS (
  SELECT p.a, p.b, p.cx, p.cy, any_value(p.m) AS m, sum(o.m * greatest(o.cx / p.cx, o.cy / p.cy)) AS shared
  FROM p JOIN p o ON p.a = o.a AND p.b = o.b GROUP BY ALL
), l AS (
  SELECT a, b FROM q JOIN c USING (a, b) JOIN n x ON x.node = a JOIN n y ON y.node = b
  GROUP BY a, b HAVING sum(m / ((x.n - c.x) / cx + (y.n - c.y) / cy + shared)) >= 0.8 - 1e-9
), r(node, root) AS (
  SELECT node, node FROM d UNION SELECT l.a, r.root FROM l JOIN r ON l.b = r.node
), g AS (
  SELECT node, min(root) AS class_id FROM r GROUP BY node
)
SELECT doc_id, class_id, copies, doc_id = class_id AS kept FROM documents JOIN d ON coalesce(text, '') = t JOIN g USING (node)
"""
