"""License scans as an exact set-similarity join, with DataFrame operations only.

A *block* is a window of ``2 m`` words that moves on by ``m`` words (``m``: the words of the
longest template), so every passage of up to ``m`` words lies inside a block whatever the line
breaks. A block matches a template when it holds at least ``threshold`` of its distinct words.

Words are ordered by their document frequency in the corpus, rarest first. If a block holds
``need = ceil(threshold * size)`` of a template's words, it holds one of the template's first
``size - need + 1``: only these prefix words are joined on. The length filter drops blocks
with fewer than ``need`` words of any template, and the positional filter those that after the
first common word at positions (i, j) of the two ordered sets have too few words left. What
remains is verified by the size of the intersection, so the result is exact.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Up to so many characters of templates (a few kB of index each hundred) their index is broadcast.
BROADCAST_CHARS = 100_000

#: Phrases whose words stand consecutively, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Usual license notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: A word once A-Z are lower-cased, and what parts words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The letters outside ASCII whose lower case holds a letter of ASCII (Kelvin sign, I with a dot).
_FALSE_FRIENDS = "\u212a\u0130"


def text_words(text: Column) -> Column:
    """The words of a non-null text, A-Z lower-cased. Splitting at the gaps takes a fifth of the time of matching the words.

    Other letters may be lower-cased too; only ASCII words are ever compared, and no letter turns into one of a-z.
    """
    friends = [text.contains(c) for c in _FALSE_FRIENDS]
    safe = F.when(friends[0] | friends[1], F.translate(text, _FALSE_FRIENDS, "\u00e5\u00e5")).otherwise(text)
    return F.split(F.lower(safe), _GAP)


def template_index(spark: SparkSession, known: DataFrame, templates, threshold: float) -> DataFrame:
    """For each prefix word: label, template, size, need, its position i, and the template's and all templates'
    words in global order, by the number of texts of ``known(known)`` that hold a word.

    As large as the list of templates, whatever the corpus.
    """
    seen = known.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rows = [
        (n, label, w, len(s := set(t.split())), ceil(threshold * len(s) - 1e-9))
        for n, (label, t) in enumerate(templates)
        for w in sorted(set(t.split()))
    ]
    words = spark.createDataFrame(rows, "template int, label string, word string, size int, need int")
    order = Window.partitionBy("template").orderBy("df", "word")
    ranked = (
        words.join(seen, "word", "left")
        .fillna(0, ["df"])
        .withColumn("i", F.row_number().over(order) - 1)
        .withColumn("key", F.struct("df", "word"))
    )
    whole = ranked.groupBy("template").agg(F.sort_array(F.collect_list("key")).alias("ordered"))
    overall = ranked.groupBy().agg(F.sort_array(F.collect_set("key")).alias("every")).withColumnRenamed("every", "all_keys")
    prefix = ranked.filter(F.col("i") <= F.col("size") - F.col("need"))
    index = prefix.join(whole, "template").join(overall)
    return index.select(
        "label", "template", "size", "need", "word", "i", F.col("ordered.word").alias("template_words"), F.col("all_keys.word").alias("all_words")
    )


def read_words(docs: DataFrame, templates, threshold: float, scratch: Scratch) -> DataFrame:
    """A saved table (row, doc_id, n_words, known, words): every text is split here and nowhere else.

    known: the words of templates and phrases that the text holds. words: all words in order, null
    for a text that can neither match a template nor hold a phrase because it lacks their words.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()} | {w for p, _ in PHRASES for w in p.split()})
    mine = F.array(*map(F.lit, vocabulary))
    texts = docs.select("doc_id", F.explode(F.array(text_words(F.coalesce(F.col("text"), F.lit(""))))).alias("split"))  # split once
    ends = (F.element_at("split", 1) == "").cast("long"), ((F.size("split") > 1) & (F.element_at("split", -1) == "")).cast("long")
    texts = texts.select("doc_id", "split", *(e.alias(f"end_{n}") for n, e in enumerate(ends)), F.array_intersect("split", mine).alias("known"))
    n_words = F.size("split") - F.col("end_0") - F.col("end_1")
    sets = [(sorted(s), ceil(threshold * len(s) - 1e-9)) for s in {frozenset(t.split()) for _, t in templates}]
    sets += [(sorted(set(p.split())), len(set(p.split()))) for p, _ in PHRASES]
    may = F.lit(False)
    for words, need in sorted(sets):
        may = may | (F.size(F.array_intersect("known", F.array(*map(F.lit, words)))) >= need)
    words = F.when(may, F.slice("split", (F.col("end_0") + 1).cast("int"), n_words.cast("int")))
    rows = texts.select("doc_id", n_words.cast("long").alias("n_words"), "known", words.alias("words"))
    return scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "words")


def places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively, from 0."""
    parts = phrase.split()

    def at(word: Column, i: Column) -> Column:
        here = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here = here & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return F.when(here, i)

    return F.array_compact(F.transform(words, at))


def matches(spark: SparkSession, read: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(row, template, label, score) for each text of ``read_words`` and template that some block matches."""
    index = template_index(spark, read.select("known"), templates, threshold)
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    stride = max(len(t.split()) for _, t in templates)
    mine = F.array(*map(F.lit, vocabulary))
    least = min(ceil(threshold * len(set(t.split())) - 1e-9) for _, t in templates)
    texts = read.filter("words is not null").select("row", "words")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - stride, F.lit(1)), F.lit(stride))
    blocks = texts.select("row", "words", F.explode(starts).alias("start")).select(
        "row", F.array_intersect(F.slice("words", F.col("start"), F.lit(2 * stride)), mine).alias("known")
    )
    blocks = blocks.filter(F.size("known") >= least)
    words = blocks.select("row", "known", F.explode("known").alias("word"))
    index = F.broadcast(index) if sum(len(t) for _, t in templates) <= BROADCAST_CHARS else index
    pairs = words.join(index, "word")
    common = F.array_intersect("template_words", "known")
    first_of_both = F.element_at(common, 1) == F.col("word")
    j = F.array_position(F.array_intersect("all_words", "known"), F.col("word"))
    left = F.lit(1) + F.least(F.col("size") - F.col("i") - 1, F.size("known") - j)
    kept = pairs.filter((F.size("known") >= F.col("need")) & (left >= F.col("need")) & first_of_both & (F.size(common) >= F.col("need")))
    return kept.select("row", "label", "template", (F.size(common) / F.col("size")).alias("score"))


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty; it and any text without a notice has no labels and score 0. A null id stays. A
    base phrase scores 1, else the score is the largest containment of a matching template; ties need
    no choice, as all labels are listed. Equal rows get equal results; a very long text is split into blocks like
    any other; only doc_id and text are read; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "licenses")
    read = read_words(docs.select("doc_id", "text"), templates, threshold, scratch)
    found = matches(spark, read, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    found = found.withColumnRenamed("row", "its_row")
    none, nowhere = F.array().cast("array<string>"), F.array().cast("array<int>")
    by_phrase = [(F.coalesce(places(F.col("words"), p), nowhere).alias(f"places_{n}"), label) for n, (p, label) in enumerate(PHRASES)]
    read = read.select("row", "doc_id", "n_words", *(c for c, _ in by_phrase))
    columns = [F.col(f"places_{n}") for n in range(len(PHRASES))]
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(columns, PHRASES, strict=True)]))
    every = F.concat(*columns)
    based = read.select(
        *("row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base")),
        *(F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base")),
    )
    return based.join(found, F.col("row") == F.col("its_row"), "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(templates=TEMPLATES, threshold: float = 0.9) -> str:
    """The same rows in DuckDB, every block compared with every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    stride = max(len(t.split()) for _, t in templates)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    places = ", ".join(
        f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: w[i + 1 : i + {len(p.split())}] = {quoted(p.split())}) AS p{n}" for n, (p, _) in enumerate(PHRASES)
    )
    every = " || ".join(f"p{n}" for n in range(len(PHRASES)))
    base = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (_, label) in enumerate(PHRASES))
    rows = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))}, {ceil(threshold * len(set(t.split())) - 1e-9)})" for label, t in templates)
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w
  FROM documents
), b AS (
  SELECT *, {places} FROM d
), f AS (
  SELECT doc_id, row, w, {every} AS p, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM b
), t(label, words, need) AS (
  VALUES {rows}
), blocks AS (
  SELECT row, list_distinct(w[s : s + {2 * stride - 1}]) AS block
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - {stride}, 1) + 1, {stride})) AS s FROM d)
), m AS (
  SELECT row, list(DISTINCT label) AS more, max(len(list_intersect(block, words))::DOUBLE / len(words)) AS best
  FROM blocks, t WHERE len(list_intersect(block, words)) >= need GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM f LEFT JOIN m USING (row)
"""
