import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsql.llm import quality, suffix_tree, toxicity, training

from .conftest import words


def good(n):
    return " ".join(f"{a} {b}" for a, b in zip(words(60, n).split(), ("of the and in to is that was for with " * 9).split(), strict=False))


def corpus(n=400):
    """(id, text, quality, toxic): shouting is bad, some words are toxic, in two inflected forms."""
    rows = []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = words(60, i).upper().replace(" ", "!! ") if bad else good(i)
        if toxic:
            text = f"{text[:80]} {('grumblax', 'zorkuend', 'zorkig')[i % 9 // 3]} {text[80:]}"
        rows.append((i, text, int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = [(d, q, t) for d, _, q, t in rows] + [(0, 1, 1), (None, 1, 0), (5, None, None), (10_000, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_samples_are_bounded_and_leave_the_held_out_fold(frames):
    docs, labels = frames
    rows = training.labelled_sample(docs, labels, "quality", 50)
    counts = Counter(label for _, label in rows)
    assert counts[0] == 50 and 49 <= counts[1] <= 50  # one labelled id has no document
    text = {t: i for i, t, *_ in corpus()}
    assert all(zlib.crc32(str(text[t]).encode()) % 5 for t, _ in rows)
    assert rows == training.labelled_sample(docs.repartition(7), labels, "quality", 50)


@pytest.mark.parametrize(("module", "label", "column", "cut"), [(quality, "quality", 2, 0.3), (toxicity, "toxic", 3, 0.5)])
def test_classifiers_on_held_out_texts(spark, frames, docs_of, odd_rows, module, label, column, cut):
    docs, labels = frames
    model = module.fit(docs, labels)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    held = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [(got[r[0]] >= cut) == bool(r[column]) for r in held]
    assert len(held) > 50 and np.mean(right) > 0.95
    odd = module.score(docs_of(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd) and odd[0].node == 1
    by_text = {}
    for r in odd:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert module.score(docs_of([]), model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_with_one_or_no_label(docs_of, odd_rows, module):
    for rows, low, high in (([], 0.4, 0.6), ([("a b", 1)] * 3, 0.99, 1), ([("a b", 0)] * 3, 0, 0.01)):
        scores = [r.score for r in module.score(docs_of(odd_rows), module.train(rows)).collect()]
        assert all(low <= s <= high for s in scores)


def test_language_guess():
    found = toxicity._of(["der hund und die katze nicht", "the cat and the dog", "los perros y una casa con", "les chats et une maison dans", "xyz", ""])
    assert [toxicity.LANGUAGES[n] for n in toxicity.guess_language(found)] == ["de", "en", "es", "fr", "", ""]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\0end"]


def test_base_scores_against_brute_force(spark, docs_of, odd_rows):
    rows = odd_rows + [(1000 + i, "the cat sat on the mat and so did the dog number %d" % (i % 9), "a") for i in range(60)]
    docs = docs_of(rows)
    learn = F.col("doc_id").isNull() | (F.col("doc_id") % 7 != 0)
    count = Counter(t for d, text, _ in rows if d is None or d % 7 for t in tokens(text))
    total, distinct = sum(count.values()), len(count)
    norm = total + 0.1 * (distinct + 1)
    got = suffix_tree.score(docs, learn).collect()
    assert len(got) == len(rows)
    text_of = {d: t for d, t, _ in rows}
    for r in got:
        own = tokens(text_of[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[t] > 0 for t in own), total)
        assert abs(r.base_score - sum(math.log10((count[t] + 0.1) / norm) for t in own)) < 1e-6 * len(own)
    repeated = [r for r in got if r.doc_id and r.doc_id >= 1000]
    assert sum(r.score for r in repeated) > 0.5 * sum(r.base_score for r in repeated)  # contexts help (scores are negative)


def brute_tree(learned, depth=3):
    """The probability of a token after a history, straight from the definition."""
    grams = Counter()
    for text in learned:
        own = ["\0start", *tokens(text)]
        for n in range(1, depth + 2):
            grams.update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    known = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "\0start"}
    norm = sum(known.values()) + 0.1 * (len(known) + 1)
    after = {}
    for g, c in grams.items():
        after.setdefault(g[:-1], {})[g[-1]] = c

    def left(context):
        listed = [c for c in after[context].values() if c >= 2]
        return 1 - sum(c - suffix_tree.DISCOUNT for c in listed) / grams[context]

    lefts = {g: left(g) for g, c in grams.items() if len(g) <= depth and g[-1] != "\0end" and c >= 2}

    def p(token, context):
        if not context:
            return (known.get(token, 0) + 0.1) / norm
        above = p(token, context[1:])
        if context not in lefts:
            return above
        c = grams[(*context, token)]
        return (c - suffix_tree.DISCOUNT if c >= 2 else 0) / grams[context] + lefts[context] * above

    def is_state(context):
        gain = sum(c * math.log(p(t, context) / p(t, context[1:])) for t, c in after[context].items())
        return gain / grams[context] >= suffix_tree.LEAST_GAIN

    states = {c for c in lefts if is_state(c)}

    def probability(token, history):
        for n in range(min(depth, len(history)), 0, -1):
            if tuple(history[-n:]) in states:
                return p(token, tuple(history[-n:]))
        return p(token, ())

    return probability, known, states


def test_scores_against_brute_force(spark):
    texts = ["a b c a b c a b d"] * 30 + ["a c b d x"] * 10 + ["once only", "d c b a once", "A B c", "", None]
    rng = np.random.default_rng(1)
    texts += [" ".join(rng.choice(list("abcdefg"), int(n))) for n in rng.integers(1, 40, 60)]
    rows = [(i, t, i % 5 != 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    probability, _, states = brute_tree([t for _, t, learn in rows if learn])
    assert 10 < len(states) and {len(s) for s in states} == {1, 2, 3}
    for segment, shard in ((suffix_tree.SEGMENT, suffix_tree.SHARD_TOKENS), (50, 64)):
        got = {r.doc_id: r.score for r in suffix_tree.score(df, df.learn, segment=segment, shard_tokens=shard).collect()}
        assert len(got) == len(rows)
        for i, text, _ in rows:
            own = ["\0start", *tokens(text)]
            want = sum(math.log10(probability(own[j], own[:j])) for j in range(1, len(own)))
            assert abs(got[i] - want) < 1e-6, (text, got[i], want)


def test_next_token_distributions_sum_to_one():
    probability, known, _ = brute_tree(["a b c a b c a b d"] * 30 + ["a c b d"] * 10)
    for history in (["\0start", "a"], ["a", "b"], ["c", "a", "b"], ["never"]):
        assert abs(sum(probability(t, history) for t in [*known, "unknown"]) - 1) < 1e-9


def test_documents_that_occur_twice_stand_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.3, 150) % 20_000)) for i in range(600)]
    twice = rows[:60]
    rows += [(1000 + i, t) for i, t in twice]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in suffix_tree.score(df, F.lit(True)).collect()}
    again, once = [got[1000 + i] for i, _ in twice], [got[i] for i in range(60, 600)]
    assert min(again) > max(once)


def test_equal_keys_are_ranked_alike():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    close = np.concatenate([keys, keys[:900], keys[:700] + np.uint64(1), keys[:700]])  # differ in the bits that the indices take
    for x in (close, keys, keys[:1], keys[:0]):
        unique, place = suffix_tree.ranked(rng.permutation(x))
        assert (unique == np.unique(x)).all() and len(place) == len(x)
    x = rng.permutation(close)
    unique, place = suffix_tree.ranked(x)
    assert (unique[place] == x).all()


def test_a_passage_repeated_a_few_times_is_learned_in_a_large_corpus(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 50_000, 3000))) for i in range(200)]
    rows += [(1000 + i, f"{passage} q{i}") for i in range(3)]
    learn = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score(learn, F.lit(True)).filter("doc_id >= 1000").collect()
    # 40 tokens at a share of 3 in 600,000; after the first the context has always been followed by the same one
    assert len(got) == 3 and all(r.score > 0.5 * r.base_score for r in got)
