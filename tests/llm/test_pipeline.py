import os
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from vecsql.llm import quality, secrets
from vecsql.llm.scratch import Scratch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, the documents first."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    scratch = Scratch(spark, "test-pipeline")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(scratch.save(stage(spark, out[-1], SF), f"s{n}"))
    return [df.collect() for df in out], [df.columns for df in out]


def test_all_stages_but_the_last_return_documents(stages):
    for columns in stages[1][1:-1]:
        assert columns == list(corpus_pipeline.COLUMNS)


def test_quality_keeps_clean_documents(spark, stages):
    (docs, kept, *_), _ = stages
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    good = [d in ids for d in held if labels[d] == 1]
    assert sum(good) >= 0.9 * len(good) and len(kept) < len(docs)


def test_one_of_each_group_stays(stages):
    (_, before, after, *_), _ = stages
    texts = {r.text for r in before}
    assert len({r.text for r in after}) == len(after) <= len(texts)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_secrets_go_and_clean_texts_stay(stages):
    (_, _, before, after, *_), _ = stages
    new = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        found = secrets.find_spans(r.text)[1]
        assert (new[r.doc_id].text == r.text) == (not found)
        assert not secrets.find_spans(new[r.doc_id].text)[1]
        assert new[r.doc_id].n_chars == (len(new[r.doc_id].text) if found else r.n_chars)


def test_mixing_takes_up_to_three_copies(stages):
    (_, _, _, before, after, _), _ = stages
    taken = Counter(r.doc_id for r in after)
    assert max(taken.values()) <= 3 and set(taken) <= {r.doc_id for r in before}


def test_packed_words_are_those_that_were_mixed(stages):
    (*_, mixed, packed), _ = stages
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(count(r.text) for r in mixed) == sum(r.n_words for r in packed) == sum(count(r.text) for r in packed)
    bins = Counter()
    for r in packed:
        bins[r.bin_id] += r.n_words
    assert max(bins.values()) <= 2048


ODD = [
    (1, "the same text of some length and then some", "en", "a", 42),
    (1, "the same text of some length and then some", "en", "a", 42),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "no id here but words all the same", "de", "b", 7),
    (4, "word " * 60_000, "en", None, 300_000),
    (5, "token = abcdefghijkl and more", "en", "b", 29),
]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash with those inside."""
    extra = "size string, source_size int, copies string, score string, spans string, its_id int, its_key string, shard string, cluster int, node int"
    rows = [(*r, "x", 1, "y", "z", "w", 2, "v", "u", 3, 4) for r in ODD]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    out = stage(spark, df, SF)
    got = out.collect()
    if name == "best-fit packing":
        assert sum(r.n_words for r in got) == sum(len((t or "").split()) for _, t, *_ in ODD)
        return
    assert out.columns == list(corpus_pipeline.COLUMNS)
    texts = Counter(r.text for r in got)
    if name == "quality classifier":
        assert set(texts) <= {r[1] for r in ODD}
    elif name == "MinHash near-dedup":
        assert len(got) == 5 and texts[ODD[0][1]] == 1  # null and empty text are one class
    elif name == "secret scans":
        assert len(got) == len(ODD) and texts["[SECRET] and more"] == 1 and texts[None] == 1
    else:
        assert set(texts) <= {r[1] for r in ODD} and max(Counter(r.doc_id for r in got if r.doc_id == 4).values(), default=0) <= 3


def test_stage_on_no_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_quality_threshold_is_that_of_the_query():
    assert quality.THRESHOLD == 0.3
