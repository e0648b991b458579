"""Operator 9: license notices in documents, with DataFrame functions only.

Base phrases are found word by word. Notices beyond them are found by an exact set-similarity join of
text blocks with license templates. A template's blocks are all windows of its length, and a part more
for words put in, over the words of a document: line breaks don't count, and words far apart don't add up.
Words are ordered by how many documents of the whole corpus hold them, rarest first; a document can have
a window that reaches the containment threshold only if it holds one of a template's first
|T| - need + 1 words (prefix), has at least `need` words (length), and has enough of the template's words
from the first shared one on (position). In what passes, each window that starts at a word of the
template is verified. What tells one license from its relatives, such as a version, must be in the window
whatever else it holds, and what names another must not.
"""

from collections.abc import Sequence
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, saved, table

#: label, phrase
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
class Template(NamedTuple):
    """A notice; a window of it must hold all `required` words of it, and no `barred` word."""

    label: str
    text: str
    required: tuple[str, ...] = ()
    barred: tuple[str, ...] = ()


_OTHER_CC = ("nd", "noderivs", "noderivatives")
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache", "license", "2")),
    Template("mit", "Released under the MIT License", ("mit", "license")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general", "public", "license", "3"), ("lesser", "library", "affero")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc", "by", "nc", "4"), ("sa", *_OTHER_CC)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution", "sharealike", "4"), ("noncommercial", "nc", *_OTHER_CC)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission", "granted")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla", "2")),
)
#: Share of a template's distinct words that a block must hold; a block has the template's words divided by it.
THRESHOLD = 0.8
#: All templates together may have so many distinct words: the word tables are then small enough to broadcast.
MAX_VOCABULARY = 20_000
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LAST = (1 << 63) - 1


def words(text: Column) -> Column:
    """Words of a text in order: A-Z lower-cased, parted by ASCII characters that are no letter or digit."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _APART, -1), lambda w: w != "")


def _python_words(text: str) -> list[str]:
    ascii_lower = text.translate({c: c + 32 for c in range(65, 91)})
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in ascii_lower).split(" ")


def _places(w: Column, phrase: str) -> Column:
    """Whether `phrase` starts at each index."""
    parts = phrase.split(" ")

    def starts(i: Column) -> Column:
        found = F.get(w, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found &= F.coalesce(F.get(w, i + k) == part, F.lit(False))
        return found

    return F.when(F.array_contains(w, parts[-1]), F.filter(F.sequence(F.lit(0), F.size(w) - 1), starts)).otherwise(F.array().cast("array<int>"))


def _labelled(label: str):
    def place(i: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), i.cast("long").alias("at"))

    return place


def _limits(template: Template, threshold: float) -> tuple[list[str], int, int]:
    """(words, distinct words that a window must hold, words of a window)."""
    tokens = [w for w in _python_words(template.text) if w]
    if missing := set(template.required) - set(tokens):
        raise ValueError(f"{template.label} has no {sorted(missing)}")
    return tokens, ceil(threshold * len(set(tokens)) - 1e-9), ceil(len(tokens) / threshold - 1e-9)


def _strings(found: Sequence[str]) -> Column:
    """An array of words, none of which has a blank."""
    return F.filter(F.split(F.lit(" ".join(found)), " "), lambda w: w != "")


def read_texts(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, did, n_words, places, hits, w): all that one reading of each text gives.

    places: (label, at) of the phrases, words counted from 0. hits: the distinct words of any template. w: the
    words of a text that has as many distinct words of some template as a window of it must hold, else null.
    """
    limits = [_limits(t, threshold) for t in templates]
    vocabulary = sorted(set().union(*(tokens for tokens, _, _ in limits)))
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"the templates have {len(vocabulary)} words; at most {MAX_VOCABULARY} are allowed")
    split = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("did"), words(F.col("text")).alias("w"))
    found = [F.transform(_places(F.col("w"), phrase), _labelled(label)) for label, phrase in phrases]
    none = F.array().cast("array<struct<label:string,at:bigint>>")
    rows = split.withColumns({"places": F.concat(*found) if found else none, "hits": F.array_intersect(_strings(vocabulary), F.col("w"))})
    enough = F.lit(False)
    for tokens, need, _ in limits:
        enough |= F.size(F.array_intersect("hits", _strings(sorted(set(tokens))))) >= need
    return rows.select("doc_id", "did", F.size("w").cast("long").alias("n_words"), "places", "hits", F.when(enough, F.col("w")).alias("w"))


def similar_blocks(texts: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(did, label, containment) of windows that hold `threshold` of a template's distinct words, the best of a document.

    texts: what `read_texts` gives with the same templates and threshold, stored.
    """
    spark = texts.sparkSession
    sets = [(t, *_limits(t, threshold)) for t in templates]
    count = {r["word"]: r["n"] for r in texts.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # template words
    vocabulary = set().union(*(tokens for _, tokens, _, _ in sets))
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    prefixes = []
    for t, tokens, need, length in sets:
        ordered = sorted(set(tokens), key=rank.__getitem__)
        prefixes += [(w, at, t.label, ordered, need, length, list(t.required), list(t.barred)) for at, w in enumerate(ordered[: len(ordered) - need + 1])]
    index = F.broadcast(spark.createDataFrame(prefixes, "word string, at int, label string, tokens array<string>, need int, length int, required array<string>, barred array<string>"))
    rare = _strings(sorted({p[0] for p in prefixes}))
    some = texts.where(F.col("w").isNotNull()).select("did", "hits", "w", F.explode_outer(F.array_intersect(rare, F.col("hits"))).alias("word"))
    met = some.join(index, "word").where(F.size("w") >= F.col("need"))
    shared = F.array_intersect("tokens", "hits")  # in the order of `tokens`
    first = F.element_at(shared, 1) == F.col("word")  # a pair once, at its first shared word
    met = met.where(first & (F.least(F.size("tokens") - F.col("at"), F.size(shared)) >= F.col("need")))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains("tokens", F.get("w", i)))

    def held(i: Column) -> Column:
        window = F.slice("w", i + 1, F.col("length"))
        told = (F.size(F.array_intersect("required", window)) == F.size("required")) & ~F.arrays_overlap("barred", window)
        return F.when(told, F.size(F.array_intersect("tokens", window))).otherwise(0)

    best = met.withColumn("held", F.array_max(F.transform(starts, held))).where(F.col("held") >= F.col("need"))
    return best.select("did", "label", (F.col("held") / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases; first_word and last_word are the smallest and largest start;
    labels adds those of the templates found; score is 1 with a phrase, else the best containment found, or 0.
    Null and empty texts have no words, no labels (empty strings) and score 0. A text's length doesn't matter:
    each of its windows is compared on its own, and the best counts, however many are equally good. Rows that
    repeat a doc_id share their templates, as do rows with a null doc_id. Other columns are ignored; an empty
    table gives an empty result.
    """
    texts = saved(read_texts(docs, phrases, templates, threshold), "texts")
    near = similar_blocks(texts, templates, threshold).groupBy("did").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    starts = F.transform("places", lambda p: p["at"])
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    none = F.array().cast(T.ArrayType(T.StringType()))
    all_labels = F.array_sort(F.array_union(base_labels, F.coalesce("more", none)))
    return texts.drop("hits", "w").join(near, "did", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    def listed(found: Sequence[str]) -> str:
        return f"CAST([{', '.join(map(repr, found))}] AS VARCHAR[])"

    limits = [(t, *_limits(t, THRESHOLD)) for t in TEMPLATES]
    quoted = ", ".join(f"('{t.label}', {listed(sorted(set(tokens)))}, {need}, {length}, {listed(t.required)}, {listed(t.barred)})" for t, tokens, need, length in limits)
    return (
        r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (
  SELECT doc_id, len(w) AS n_words,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND coalesce(w[i+1], '') = 'by') AS a,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND coalesce(w[i+1], '') = 'public' AND coalesce(w[i+2], '') = 'license') AS b,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND coalesce(w[i+1], '') = 'rights' AND coalesce(w[i+2], '') = 'reserved') AS c
  FROM w),
q AS (
  SELECT doc_id, n_words, list_concat(list_concat(a, b), c) AS pl,
    list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS base
  FROM p),
t(label, tokens, need, length, required, barred) AS (VALUES """
        + quoted
        + r"""),
x AS (
  SELECT doc_id, w, t.*, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(tokens, w[i]))) AS start
  FROM w, t WHERE len(list_intersect(tokens, w)) >= need),
v AS (SELECT doc_id, label, tokens, need, required, barred, w[start:start + length - 1] AS own FROM x),
m AS (
  SELECT doc_id, list_sort(list_distinct(list(label))) AS more, max(len(list_intersect(tokens, own)) / len(tokens)) AS best
  FROM v WHERE len(list_intersect(tokens, own)) >= need AND list_has_all(own, required) AND NOT list_has_any(own, barred) GROUP BY doc_id)
SELECT q.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(pl) AS BIGINT) AS n_base,
  CASE WHEN len(pl) > 0 THEN list_min(pl) - 1 END AS first_word, CASE WHEN len(pl) > 0 THEN list_max(pl) - 1 END AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(pl) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM q LEFT JOIN m ON q.doc_id = m.doc_id
"""
    )


QUERIES = {"op9_license_scan": query}
ORACLE_SQL = {"op9_license_scan": _sql()}
