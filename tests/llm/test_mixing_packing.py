import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vecsql.llm import mixing, packing


def reference_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above its bound stops there and the rest is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, free = {}, set(names)
    while free:
        rest = sum(sizes.values()) - sum(stopped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in above}
        free -= above
    return stopped


def test_mixing_against_brute_force(spark, docs_of, odd_rows):
    got = mixing.mixed(spark, docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    sizes = Counter()
    for _, text, source in odd_rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = reference_targets(dict(sizes))
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        u = int(hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}|{r.text or ''}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.copies == int(rate) + (u < rate - int(rate)) <= 3
    copies = mixing.emit_copies(mixing.mixed(spark, docs_of(odd_rows)), ["doc_id", "text"]).count()
    assert copies == sum(r.copies for r in got)


def test_mixing_comes_near_targets(spark, docs_of):
    rows = [(i, "w " * (10 + i % 7), f"s{i % 5}") for i in range(4000)]
    got = mixing.mixed(spark, docs_of(rows)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    for r in got.collect():
        assert abs(r.taken - r.target) < 0.08 * r.target


def test_empty_tables(spark, docs_of):
    assert mixing.mixed(spark, docs_of([])).count() == 0
    assert packing.pack(docs_of([])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    # bins: 0 holds 6 of a, 1 holds 7 of b; the 3 of c fits bin 1 exactly
    assert packing.best_fit([7, 6, 3], ["b", "a", "c"], [1, 2, 3], capacity=10, per_source=1) == [0, 1, 0]
    # of source b again: the tightest bin has one already, the next is taken
    assert packing.best_fit([7, 6, 3], ["b", "a", "b"], [1, 2, 3], capacity=10, per_source=1) == [0, 1, 1]
    # a duplicate of both: no bin is compatible
    assert packing.best_fit([7, 6, 3], ["b", "a", "c"], [1, 2, 1], capacity=10, per_source=1) == [0, 1, 1]
    assert packing.best_fit([4, 3, 2], ["a", "a", "a"], [1, 2, 3], capacity=10, per_source=2) == [0, 0, 1]


def brute_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(capacity - sum(x[0] for x in b), n) for n, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= max(size, 1) and sum(x[1] == s for x in b) < per_source and all(x[2] != c for x in b)]
        n = min(fits)[1] if fits else len(bins)
        if n == len(bins):
            bins.append([])
        bins[n].append((size, s, c))
        out.append(n)
    return out


def test_best_fit_against_brute_force():
    import random

    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(1, 60)
        sizes = [r.randrange(1, 20) for _ in range(n)]
        sources, clusters = [r.randrange(4) for _ in range(n)], [r.randrange(12) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 20, 2) == brute_best_fit(sizes, sources, clusters, 20, 2)


def test_packing_keeps_all_words_and_the_constraints(spark, docs_of, odd_rows):
    for shard_bytes in (1 << 30, 4000):
        got = packing.pack(docs_of(odd_rows), capacity=64, shard_bytes=shard_bytes).collect()
        bins = defaultdict(list)
        for r in got:
            bins[r.bin_id].append(r)
        for rows in bins.values():
            rows.sort(key=lambda r: r.slot)
            assert [r.slot for r in rows] == list(range(len(rows)))
            assert sum(r.n_words for r in rows) <= 64
            assert max(Counter(r.source for r in rows).values()) <= packing.PER_SOURCE
            at = 0
            for r in rows:
                assert r.position == at
                at += r.n_words
        whole = defaultdict(list)
        for r in got:
            whole[r.doc_id].append(r)
        for doc_id, text, _ in odd_rows:
            pieces = sorted({(r.piece, r.text) for r in whole[doc_id]})
            assert "".join(t for _, t in pieces) == (text or "")
        assert len({r.bin_id for r in whole[1] + whole[2]}) == len(whole[1]) + len(whole[2]) == 3  # equal texts apart


def test_repeated_rows_are_dealt_to_all_shards(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    got = packing.pack(docs_of([(1, text, "a")] * 600).coalesce(2), capacity=400, shard_bytes=4000).collect()
    shards = Counter(r.bin_id >> 32 for r in got)
    assert len(got) == 600 and len(shards) > 30 and max(shards.values()) < 30
    assert len({r.bin_id for r in got}) == 600  # of one cluster


def test_clusters_may_be_given(spark):
    rows = [(i, f"text number {i} of the lot", "s", i // 2 if i < 8 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, class_id long")
    packed = packing.pack(df, per_source=12, cluster="class_id")
    bin_of = {r.doc_id: r.bin_id for r in packed.collect()}
    assert all(bin_of[2 * i] != bin_of[2 * i + 1] for i in range(4)) and len(set(bin_of.values())) == 2
    whole = packing.fill(packed).first()
    assert whole.bins == 2 and whole.words == 72 and abs(whole.fill - 72 / 4096) < 1e-12
    assert packing.fill(packing.pack(df.limit(0))).first().fill == 0
