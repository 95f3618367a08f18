"""The registered queries as they are, on the smallest tables, against plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from vecsql.llm import quality, queries, secrets, toxicity
from vecsql.llm.words import words as split

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize(("name", "label", "cut"), [("op1_quality", "quality", 0.3), ("op10_toxicity", "toxic", 0.5)])
def test_classifier_queries(spark, documents, labels, name, label, cut):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [(r.predicted, getattr(labels[r.doc_id], label)) for r in rows if r.held_out and r.doc_id in labels]
    held = [(p, t) for p, t in held if t is not None]
    assert np.mean([p == t for p, t in held]) > 0.85 and len(held) > 10


def test_quality_scores_against_plain_compression(spark, documents, labels):
    rows = [(documents[d].text, r.quality) for d, r in sorted(labels.items()) if d in documents and documents[d].text and r.quality is not None]
    model = quality.train(rows)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    quiet = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    for r in quality.score(df, model).collect()[:60]:
        data, sizes = (r.text or "").encode(), []
        for dictionary in (model.good, model.bad):
            blocks = [data[i : i + 512] for i in range(0, len(data), 512)] or [b""]
            sizes.append(sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), **quiet).compress(b)) for b in blocks))
        x = (sizes[1] - sizes[0]) / (len(data) + quality.PRIOR_BYTES)
        assert abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, model.slope * x / model.scale + model.offset))))) < 1e-12


def test_toxicity_scores_against_a_plain_convolution(spark, documents, labels):
    rows = [(documents[d].text, r.toxic) for d, r in sorted(labels.items()) if d in documents and documents[d].text and r.toxic is not None]
    model = toxicity.train(rows)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    row = lambda h: int(h % np.uint64(toxicity.BUCKETS - 1)) + 1 if h else 0
    for r in sorted(toxicity.score(df, model).collect(), key=lambda r: len(r.text or ""))[:80]:
        found = toxicity._of([r.text or ""])
        vectors = [model.embeddings[row(h)] + sum(model.embeddings[row(p[i])] for p in found.prefixes) for i, h in enumerate(found.hashes)]
        pooled = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = 0.0
                for i in range(len(vectors)):
                    best = max(best, sum(float(vectors[i + k] @ model.filters[w][k][:, f]) for k in range(w) if i + k < len(vectors)) + float(model.biases[w][f]))
                pooled.append(best)
        z = float(np.dot(pooled, model.output)) + model.offset - model.shifts[toxicity.guess_language(found)[0]]
        assert abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-4


def test_license_query(spark, documents):
    rows = queries.QUERIES["op2_licenses"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(documents[r.doc_id].text))
        at = [i for p in ("under the mit license", "apache license version 2", "cc by nc") for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_mixing_query(spark, documents):
    rows = queries.QUERIES["op3_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in documents.items()}
    by_source = Counter()
    for d, r in documents.items():
        by_source[r.source] += size[d]
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in by_source)
    weights, total = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}, sum(by_source.values())
    target, stopped = {}, set()
    while True:
        rest = total - sum(3 * by_source[s] for s in stopped)
        shares = sum(weights[s] for s in names if s not in stopped)
        target = {s: 3 * by_source[s] if s in stopped else rest * weights[s] / shares for s in names}
        over = {s for s in names if s not in stopped and target[s] > 3 * by_source[s]}
        if not over:
            break
        stopped |= over
    taken = Counter()
    for r in rows:
        source = documents[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[source]) and abs(r.target - target[source]) < 1e-6 * max(1, target[source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) < 0.5 * target[s] + 4000 for s in names)
    assert sorted(map(str, rows)) == sorted(map(str, queries.QUERIES["op3_mixing"](spark, SF).collect()))


def test_near_dedup_query(spark, documents):
    rows = queries.QUERIES["op4_near_dedup"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    by_text = Counter(r.text or "" for r in documents.values())
    for r in rows:
        assert r.copies == by_text[documents[r.doc_id].text or ""] and r.kept == (r.doc_id == r.class_id) and r.class_id <= r.doc_id


def test_vector_query(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    m = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    hit = m @ m.T >= 0.9
    np.fill_diagonal(hit, False)
    rows = {r.vec_id: r for r in queries.QUERIES["op5_vector_dedup"](spark, SF).collect()}
    assert sorted(rows) == ids
    for n, i in enumerate(ids):
        assert rows[i].n_links == hit[n].sum() and rows[i].kept == (rows[i].component_id == i)
        assert all(rows[ids[o]].component_id == rows[i].component_id for o in np.flatnonzero(hit[n]))


def test_packing_query(spark, documents):
    rows = queries.QUERIES["op6_packing"](spark, SF).collect()
    words_of, bins = Counter(), {}
    for r in rows:
        words_of[r.doc_id] += r.n_words
        bins.setdefault(r.bin_id, []).append(r)
    assert {d: words_of[d] for d in documents} == {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in documents.items()}
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 2048 and len({documents[r.doc_id].text for r in held}) == len(held)
        assert max(Counter(r.source for r in held).values()) <= 4


def test_secret_query(spark):
    sf = SF.replace("sf0.001", "sf0.01")  # the smallest table has none
    documents = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_secrets"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    some = 0
    for r in rows:
        text = documents[r.doc_id].text or ""
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[1]) >= 8]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        listed = [s for *_, s in sorted(base)]
        counts = Counter(s.split(":")[0] for s in listed)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert not Counter(listed) - Counter(every)
        assert every == [":".join(map(str, s)) for s in secrets.find_spans(text)[1]]
        some += bool(listed)
    assert some


def test_image_query(spark):
    ids = sorted(r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    rows = queries.QUERIES["op8_image_copies"](spark, SF).collect()
    assert sorted(r.vec_id for r in rows) == ids
    heads = {r.vec_id for r in rows if r.kept}
    assert {r.class_id for r in rows} == heads
    assert all(r.n_links > 0 for r in rows if not r.kept and r.n_corners)
    # pictures are drawn alike where the three largest components are the same
    drawn = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        big = np.argsort(-np.abs(np.array(r.embedding)), kind="stable")[:3]
        drawn.setdefault(tuple((int(b), r.embedding[b] < 0) for b in big), []).append(r.vec_id)
    want = {i: min(own) for own in drawn.values() for i in own}
    assert np.mean([r.class_id == want[r.vec_id] for r in rows]) > 0.99


def test_suffix_tree_query(spark, documents):
    rows = queries.QUERIES["op9_suffix_tree"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(r.text)), None] for d, r in documents.items()}
    count = Counter(t for d, own in tokens.items() if crc(d) % 10 for t in own)
    total, norm = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 10 == 0, len(own), sum(count[t] > 0 for t in own), total)
        assert abs(r.base_score - sum(math.log10((count[t] + 0.1) / norm) for t in own)) < 1e-7 * len(own) and r.score <= 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    from vecsql.llm.words import text_buffer

    assert split(*text_buffer(pa.array(["A b-c é_d 9"]))).counts.tolist() == [6]
