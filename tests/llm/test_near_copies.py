import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsql.llm import images, linking, near_dedup, vector_dedup
from vecsql.llm.hnsw import build
from vecsql.llm.scratch import Scratch

from .conftest import words


def shingles(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def edited(text, share, seed):
    r = random.Random(seed)
    w = text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_against_brute_force(spark, docs_of, odd_rows):
    base = words(200, 77)
    rows = odd_rows + [(1000 + i, edited(base, 0.001 * (i % 40), i), f"s{i % 3}") for i in range(60)]
    rows += [(2000 + i, words(40, 500 + i), "a") for i in range(20)] + [(2100 + i, words(40, 500 + i), "b") for i in range(3)]
    classes = {}
    for d, t, _ in rows:
        classes.setdefault(t or "", []).append(d)
    ids = {t: min(d for d in own if d is not None) for t, own in classes.items() if any(d is not None for d in own)}
    sets = {ids[t]: shingles(t) for t in ids}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    found, linked = near_dedup.groups(docs_of(rows))
    got = found.collect()
    assert len(got) == len(rows)
    text_of = {d: t or "" for d, t, _ in rows}
    for r in got:
        if r.doc_id is None:
            assert r.class_id is None and r.kept
        else:
            assert r.class_id == want[ids[text_of[r.doc_id]]]
            assert r.kept == (r.class_id == r.doc_id)
            assert r.copies == len(classes[text_of[r.doc_id]])
    assert {(r.a, r.b) for r in linked.collect()} <= set(links)
    kept = near_dedup.dedup(docs_of(rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values())) and len(kept) == len(set(want.values())) + 1
    assert kept[0].node == 1


def bag(text):
    import re
    from collections import Counter

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def probability_jaccard(x, y):
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_repeated_lines_and_templates_against_brute_force(spark, docs_of):
    """Texts that differ in how often lines are repeated, and pages of one template below the threshold."""
    base, line = words(300, 9), words(12, 10)
    texts = [base] + [f"{base} {' '.join([line] * n)}" for n in (1, 2, 3, 5, 8, 20, 400)]
    texts += [" ".join([line] * n) for n in (1, 2, 30, 31)]
    common = words(300, 11)
    texts += [f"{common} {words(n, 900 + k)}" for k, n in enumerate([20, 30, 40, 60, 80, 100] * 6)]
    bags = [bag(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if probability_jaccard(bags[a], bags[b]) >= 0.8 - 1e-9]
    by_set = [(a, b) for a in range(len(texts)) for b in range(a) if len(bags[a].keys() & bags[b].keys()) >= 0.8 * len(bags[a].keys() | bags[b].keys())]
    assert set(links) != set(by_set) and len(links) > 20
    want = smallest_reachable(range(len(texts)), links)
    found, linked = near_dedup.groups(docs_of([(i, t, "a") for i, t in enumerate(texts)]))
    assert {r.doc_id: r.class_id for r in found.collect()} == want
    for r in linked.collect():
        assert abs(r.similarity - probability_jaccard(bags[r.a], bags[r.b])) < 1e-6


def test_near_dedup_of_nothing(docs_of):
    assert near_dedup.dedup(docs_of([])).count() == 0
    assert near_dedup.groups(docs_of([]))[0].count() == 0


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    hashes = np.concatenate([h[:300], h[100:]])
    rows = np.repeat([0, 1], 300)
    s = near_dedup.signatures(hashes, rows, np.concatenate([wa, wb]), 2, 4000)
    p = {int(x): w / wa.sum() for x, w in zip(h[:300], wa, strict=True)}
    q = {int(x): w / wb.sum() for x, w in zip(h[100:], wb, strict=True)}
    true = sum(1 / sum(max(p.get(y, 0) / p[x], q.get(y, 0) / q[x]) for y in p.keys() | q.keys()) for x in p.keys() & q.keys())
    assert abs((s[0] == s[1]).mean() - true) < 0.03


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = linking.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t").collect()
    want = smallest_reachable({x for e in edges for x in e}, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {x.node: x.root for x in got} == {n: want[n] for n in touched} and len(got) == len(touched)
    assert linking.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "t").count() == 0


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    for i in range(0, 300, 3):  # copies around some, one group large
        x[i + 1] = x[i] + rng.normal(0, 0.1, 16)
        x[i + 2] = 3 * x[i] + rng.normal(0, 0.2, 16)
    x[600:750] = x[600] + rng.normal(0, 0.12, (150, 16))
    return np.unique(x.astype(np.float32), axis=0)[rng.permutation(900)]


def test_graph_search_finds_neighbours(cloud):
    v = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    graph = build(v[:800])
    ids, _ = graph.nearest(v[800:], 64)
    true = np.argsort(-(v[800:] @ v[:800].T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids[:, :10].tolist(), true.tolist(), strict=True)]) > 0.95
    same = type(graph).loads(graph.dumps())
    assert (same.nearest(v[800:], 64)[0] == ids).all()


def test_vectors_against_brute_force(spark, cloud):
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0, None] * 8), (5004, [float("nan")] * 16), (5005, [float("inf")] * 16), (5006, [1.0, 2.0])]
    copies = [(6000 + i, cloud[7].tolist()) for i in range(40)] + [(None, cloud[9].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(cloud)] + odd + copies
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, node int, copies string")
    got = vector_dedup.linked(spark, df, block_nodes=300).collect()
    assert len(got) == len(rows)
    full = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.stack([v for _, v in full])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= 0.9
    np.fill_diagonal(hit, False)
    numbers = range(len(full))
    root = smallest_reachable(numbers, zip(*(x.tolist() for x in np.nonzero(hit)), strict=True))
    least = {}
    for n in numbers:
        if full[n][0] is not None:
            least[root[n]] = min(least.get(root[n], 1 << 60), full[n][0])
    want = {full[n][0]: (int(hit[n].sum()), least[root[n]]) for n in numbers}
    true, found = sum(w[0] for w in want.values()), 0
    for r in got:
        n_links, component = want.get(r.vec_id, (0, r.vec_id))
        assert r.n_links <= n_links and r.component_id == component and r.kept == (r.vec_id == component)
        found += r.n_links
    assert found >= 0.98 * true
    assert vector_dedup.linked(spark, df.limit(0)).count() == 0


def test_recall_of_audits(cloud):
    v = (cloud / np.linalg.norm(cloud, axis=1, keepdims=True)).astype(np.float32)
    graph = build(v)
    own = np.array([int(np.flatnonzero((graph.vectors == x).all(1))[0]) for x in v])
    links, beam, recall = vector_dedup.audited_links(graph, v, 0.9, own)
    true = v @ graph.vectors.T >= 0.9
    true[np.arange(len(v)), own] = False
    shares = [np.isin(np.flatnonzero(t), f).mean() for t, f in zip(true, links, strict=True) if t.any()]
    assert recall >= 0.99 and np.mean(shares) >= 0.98 and beam >= 0


def test_a_shard_travels_in_small_rows_and_large_groups_are_not_held(cloud, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(vector_dedup, "PIECE_BYTES", 10_000)
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(6000, 16))).astype(np.float32)  # all alike
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 16, dtype=np.int32)), pa.array(v.ravel()))
    nodes = pa.table({"dim": pa.array([16] * len(v), pa.int32()), "shard": pa.array([3] * len(v), pa.int32()), "node": np.arange(len(v)) * 2, "copies": np.ones(len(v), np.int64), "vector": column})
    pieces = vector_dedup._build(nodes)
    assert len(pieces) > 10 and max(len(x.as_py()) for x in pieces.column("data")) <= 10_000
    tracemalloc.start()
    got = vector_dedup._search(0.9, nodes, pieces.take(rng.permutation(len(pieces))))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20  # all links at once: 288 MB more
    tracemalloc.stop()
    counts = got.filter(pa.compute.is_null(got.column("other")))
    assert len(counts) == len(v) and set(counts.column("copies").to_pylist()) == {len(v) - 1}
    assert len(got) - len(counts) == len(v) - 1


def test_forests_of_links():
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    root = np.arange(200)
    for part in (links[:70], links[70:]):
        root = vector_dedup.spanning(*(np.array(x) for x in zip(*part, strict=True)), root)
    want = smallest_reachable(range(200), links)
    assert root.tolist() == [want[n] for n in range(200)]


def test_images(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(12, 64))
    rows = [(10 * i + k, images.drawing(v, 10 * i + k)) for i, v in enumerate(vectors) for k in range(4)]
    turned = images.encode(np.rot90(images.decode(rows[0][1])))
    rows += [(900, None), (901, None), (902, b""), (903, b"P5 3 3 255\n" + bytes(9)), (904, b"no picture"), (905, rows[5][1]), (906, turned), (None, rows[0][1])]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "x") for i, b in rows], "id long, image binary, node string")
    got = {r.id: r for r in images.copies(df).collect()}
    assert len(got) == len(rows)
    for i in range(48):
        n, k = divmod(i, 4)
        assert got[10 * n + k].class_id == 10 * n
    assert got[905].class_id == 10 and got[906].class_id == 0 and got[None].class_id == 0
    assert [got[i].class_id for i in (900, 901, 902, 903, 904)] == [900, 901, 902, 903, 904] and got[900].n_corners == 0
    assert images.copies(df.limit(0)).count() == 0


def test_images_of_harder_edits_against_all_pairs(spark):
    """Blurred, resized and noisy copies are grouped as comparing all pairs groups them."""
    rng = np.random.default_rng(5)
    pictures = [images.decode(images.drawing(v, i)) for i, v in enumerate(rng.normal(size=(10, 64)))]
    edits = [lambda b: b, lambda b: images._box(b, 2) / 25, lambda b: images._shrunk(b, 0.8), lambda b: images._shrunk(b, 0.9), lambda b: b + rng.normal(0, 20, b.shape)]
    rows = [(10 * i + k, images.encode(edit(b))) for i, b in enumerate(pictures) for k, edit in enumerate(edits)]
    seen = {i: images.describe(images.decode(b)) for i, b in rows}
    links = [(a, b) for a in seen for b in seen if a < b and images.inliers(*seen[a], *seen[b]) >= images.LEAST_INLIERS]
    want = smallest_reachable(seen, links)
    got = {r.id: r.class_id for r in images.copies(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, image binary")).collect()}
    assert got == want and all(want[i] == i // 10 * 10 for i in want)


def test_ppm_and_bad_headers():
    assert images.decode(b"P6\n# c\n2 1 255\n" + bytes([3, 3, 3, 9, 9, 9])).tolist() == [[3.0, 9.0]]
    assert images.decode(b"P5 2 2 255\n\0") is None and images.decode(b"P5 0 2 255\n") is None


def test_first_pass_only_uses_hubs(spark):
    """A bucket of n alike members costs n pairs."""
    members = spark.range(200).select(F.col("id").alias("node"), F.lit(1).alias("bucket"))
    tested = []

    def verify(pairs, again):
        tested.append(pairs.count())
        return pairs

    links, roots = linking.linked_groups(members, verify, lambda x, y: (x, y, F.lit(True)), Scratch(spark, "test"))
    assert tested == [199, 0] and links.count() == 199 and roots.select("root").distinct().count() == 1


def test_pictures_of_two_components_are_compared_by_all_their_members(spark, monkeypatch):
    given = []
    monkeypatch.setattr(images, "linked_groups", lambda members, verify, alike, scratch: given.append(alike) or linking.linked_groups(members, verify, alike, scratch))
    images.copies(spark.createDataFrame([(1, None)], "id long, image binary")).collect()
    # the hub of bucket 1 is 0; those of most reach of the components 1, 2 and 3, 4 are 1 and 3, which are not alike
    members = spark.createDataFrame([(n, 1) for n in range(5)] + [(1, 2), (2, 2), (3, 3), (4, 3)] + [(n, 4) for n in (0, 5, 6, 7)], "node long, bucket long")
    true = F.concat_ws("-", "a", "b").isin("1-2", "3-4", "2-4")
    links, roots = linking.linked_groups(members, lambda pairs, _: pairs.filter(true), given[0], Scratch(spark, "test"))
    assert {(r.a, r.b) for r in links.collect()} == {(1, 2), (3, 4), (2, 4)}
    assert {r.node: r.root for r in roots.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_pictures_meet_in_blocks_without_a_row_a_pair(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(21)
    rows = [(10 * i + k, images.drawing(v, 10 * i + k)) for i, v in enumerate(rng.normal(size=(8, 64))) for k in range(5)]
    seen = {i: images.describe(images.decode(b)) for i, b in rows}
    keys = {i: set(images.table_keys(bits).tolist()) for i, (_, bits) in seen.items()}
    links = [(a, b) for a in seen for b in seen if a < b and keys[a] & keys[b] and images.inliers(*seen[a], *seen[b]) >= images.LEAST_INLIERS]
    monkeypatch.setattr(images, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(images, "ROUND_BYTES", 60_000)
    got = images.copies(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, image binary")).collect()
    assert {r.id: r.class_id for r in got} == smallest_reachable(seen, links)
    # a group of n pictures costs n - 1 links, in one block or in two
    monkeypatch.setattr(images, "PIECE_BYTES", 2_000)
    group = [images.describe(images.decode(images.drawing(np.arange(64.0), k))) for k in range(40)]
    block = pa.table({"node": range(40), "block": pa.array([0] * 40, pa.int32()), "places": [p.astype(np.float32).tobytes() for p, _ in group], "bits": [b.tobytes() for _, b in group]})
    two = block.set_column(1, "block", pa.array([k % 2 for k in range(40)], pa.int32()))
    one, first, second = images._pack(block), *(images._pack(two.filter(pa.compute.equal(two.column("block"), n))) for n in (0, 1))
    assert len(one) > 5
    for pieces, i, j in ((one, 0, 0), (pa.concat_tables([second, first]), 0, 1)):
        ends = pa.array([i] * len(pieces), pa.int32()), pa.array([j] * len(pieces), pa.int32())
        assert len(images._compare(pieces.append_column("i", ends[0]).append_column("j", ends[1]))) == 39


def test_keys_of_a_block_of_pictures_are_made_at_once(monkeypatch):
    import pyarrow as pa

    seen = [images.describe(images.decode(images.drawing(np.roll(np.arange(64.0), k // 4), k))) for k in range(24)] + [images.describe(None)]
    keys = [set(images.table_keys(bits).tolist()) for _, bits in seen]
    owner, bucket = images._shared_keys(np.concatenate([b for _, b in seen]), np.repeat(np.arange(len(seen)), [len(b) for _, b in seen]), len(seen))
    got = {(a, b) for a, x in zip(owner.tolist(), bucket.tolist(), strict=True) for b, y in zip(owner.tolist(), bucket.tolist(), strict=True) if x == y and a < b}
    assert got == {(a, b) for a in range(len(seen)) for b in range(a + 1, len(seen)) if keys[a] & keys[b]} and got
    assert not len(images._shared_keys(seen[-1][1], np.zeros(0, np.int64), 1)[0]) and not len(images._shared_keys(seen[0][1][:1], np.zeros(1, np.int64), 1)[0])
    for a in seen:
        for b in seen:
            assert (images.inliers(*a, *b, images.LEAST_INLIERS) >= images.LEAST_INLIERS) == (images.inliers(*a, *b) >= images.LEAST_INLIERS)
    calls, one_by_one = [], images._keys
    monkeypatch.setattr(images, "_keys", lambda bits: calls.append(len(bits)) or one_by_one(bits))
    block = pa.table({"node": range(24), "block": pa.array([0] * 24, pa.int32()), "places": [p.astype(np.float32).tobytes() for p, _ in seen[:24]], "bits": [b.tobytes() for _, b in seen[:24]]})
    pieces = images._pack(block)
    links = images._compare(pieces.append_column("i", pa.array([0] * len(pieces), pa.int32())).append_column("j", pa.array([0] * len(pieces), pa.int32())))
    assert calls == [sum(len(b) for _, b in seen)] and len(links) >= 18


def test_texts_of_one_template_meet_in_tasks_without_a_row_a_pair():
    import pyarrow as pa

    r = random.Random(4)
    common = words(60, 21)
    texts = [f"{edited(common, 0.003 * (k % 6), k)} {words(r.randrange(4, 12), 700 + k)}" for k in range(60)] + [f"{common} {words(6, 700)}"] * 2
    signed = pa.Table.from_batches(near_dedup._sign(iter([pa.record_batch([pa.array(range(62)), pa.array(texts), pa.array(texts)], ["doc_id", "text_key", "text"])])))
    bags = pa.Table.from_batches(near_dedup._shingle_counts(iter([pa.record_batch([pa.array(range(62)), pa.array(texts)], ["node", "text"])])))
    full = [bag(t) for t in texts]
    bands = signed.column("bands").to_pylist()
    pairs = {(a, b) for a in range(62) for b in range(a + 1, 62) if set(bands[a]) & set(bands[b])}
    links = {(a, b) for a, b in pairs if probability_jaccard(full[a], full[b]) >= 0.8 - 1e-9}
    assert len(pairs) > 300 and 1 < len(links) < len(pairs) / 2

    def rows(blocks):
        """Members of each bucket, all apart, as ``_met`` deals them."""
        out = []
        for n in range(62):
            for bucket in bands[n]:
                for other in range(blocks):
                    i, j = sorted((n % blocks, other))
                    out.append((i, j, {"node": n, "bucket": bucket, "root": n, "apart": True, "i": i, "j": j, "block": n % blocks}))
        return [[x for i, j, x in out if (i, j) == at] for at in sorted({(i, j) for i, j, _ in out})]

    def table(group):
        own = pa.array([x["node"] for x in group])
        t = pa.Table.from_pylist(group)
        return t.append_column("sign", signed.column("sign").take(own)).append_column("bands", signed.column("bands").take(own)).append_column("shingles", bags.column("shingles").take(own)).append_column("counts", bags.column("counts").take(own))

    for blocks in (1, 3):
        near = pa.concat_tables([near_dedup._meeting(near_dedup.LEAST_ESTIMATE, None)(table(g)) for g in rows(blocks)])
        assert {n for link in links for n in link} <= set(near.column("node").to_pylist())
        found = [x for g in rows(blocks) for x in near_dedup._meeting(near_dedup.LEAST_ESTIMATE, near_dedup.SIMILARITY)(table(g)).to_pylist()]
        got = [(x["a"], x["b"]) for x in found]
        assert set(got) <= links and smallest_reachable(range(62), got) == smallest_reachable(range(62), links)
        assert blocks > 1 or len(got) < 62  # a spanning forest
        assert all(abs(x["similarity"] - probability_jaccard(full[x["a"]], full[x["b"]])) < 1e-6 for x in found)
