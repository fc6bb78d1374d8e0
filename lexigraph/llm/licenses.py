"""License scan: exact set-similarity (containment) join of text blocks with license templates.

Native DataFrame operations only. A block for a template is a run of consecutive words of a
text, half as many again as the template has, from any place on: line breaks, comment marks
and punctuation do not matter. A template T is found in a text when at least
ceil(threshold * |T|) of T's distinct words are in one of its blocks.

The join: a text's words that any template has are kept with their places. Words are ordered
globally, rarest first, by the number of texts of the whole corpus that have them. A text
with a block of T has one of T's first |T| - ceil(threshold * |T|) + 1 words (prefix filter),
has at least ceil(threshold * |T|) words (length filter), and from its first shared word on
it has enough words in the global order (positional filter). What passes is verified: first
by all of the text's words, then by each block, as a window over the places of T's words.

Templates are a table, a parameter of a few thousand words; the corpus does not change its
size. It is broadcast; all filters and the verification are joins with it.

Defined cases: a null text counts as empty (no words, no labels, score 0); ties in word
frequency are broken by the word; rows that share doc_id and text get equal results; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, whole_text
from .license_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
THRESHOLD = 0.8

#: Base phrases and their labels (fixed by the query's contract).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def all_words(text: str) -> list[str]:
    """The words of a template, in Python (templates are parameters, not data)."""
    return re.findall(WORD, text.translate(_FOLD))


def words_of(text: str) -> list[str]:
    return sorted(set(all_words(text)))


def needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def block_size(text: str) -> int:
    """Words of a block for this template."""
    return math.ceil(1.5 * len(all_words(text)))


def text_words(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row the number of words, the places of base phrases, and the words that templates have, with their places."""
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    words = F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(WORD), 0)
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), words.alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at")))), lambda h: h.isNotNull())
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    places = F.when(F.exists("words", lambda w: w == "license"), phrase_places(F.col("words"))).otherwise(none)
    return rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), places.alias("places"), hits.alias("hits"))


def phrase_places(words: Column) -> Column:
    """Starts of the base phrases in an array of lower-cased words: array<struct<at, label>>."""
    return F.concat(*[_places_of(words, phrase.split(" "), label) for phrase, label in PHRASES])


def _places_of(words: Column, parts: list[str], label: str) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    at = F.filter(starts, lambda i: functools.reduce(lambda a, b: a & b, [F.get(words, i + j) == p for j, p in enumerate(parts)]))
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def containment_join(rows: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, label, the greatest containment of the template in a block of the text, and that block's first start and length; rows: of text_words, written."""
    spark = rows.sparkSession
    sets = {label: words_of(text) for label, text in templates}
    own = rows.where(F.size("hits") > 0).select("doc_id", "text_key", "n_words", "hits", F.array_distinct("hits.word").alias("words"))
    seen = {r["word"]: r["n"] for r in own.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the templates' words
    rank = {w: i for i, w in enumerate(sorted({w for s in sets.values() for w in s}, key=lambda w: (seen.get(w, 0), w)))}
    prefix, table = [], []
    for label, text in templates:
        ordered = sorted(sets[label], key=rank.get)
        least = needed(len(ordered), threshold)
        table.append((label, ordered, len(ordered), least, block_size(text)))
        prefix += [(rank[w], w, label, len(ordered), least) for w in ordered[: len(ordered) - least + 1]]
    index = spark.createDataFrame(prefix, "rank int, word string, label string, size int, least int")
    whole = F.broadcast(spark.createDataFrame(table, "label string, own array<string>, size int, least int, block int"))
    ranks = F.broadcast(spark.createDataFrame([(w, i) for w, i in rank.items()], "word string, rank int"))

    # the words of each text in the global order; those of the prefixes look for templates
    starts = index.select("word").distinct().withColumnRenamed("word", "start")
    slim = own.select("doc_id", "text_key", "n_words", "words").dropDuplicates(["doc_id", "text_key"])
    able = slim.where(F.exists("words", lambda w: w.isin([r[1] for r in prefix])))
    ordered = able.select("doc_id", "text_key", "n_words", "words", F.explode("words").alias("word")).join(ranks, "word")
    place = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("rank")) - 1
    probes = ordered.select("doc_id", "text_key", "n_words", "words", "word", place.alias("place")).join(F.broadcast(starts), F.col("word") == F.col("start"), "left_semi")
    met = probes.join(F.broadcast(index.select("word", "label", "least")), "word").where((F.col("n_words") >= F.col("least")) & (F.size("words") - F.col("place") >= F.col("least")))
    candidates = met.select("doc_id", "text_key", "words", "label").dropDuplicates(["doc_id", "text_key", "label"])
    candidates = candidates.join(whole, "label").where(F.size(F.array_intersect("words", "own")) >= F.col("least")).select("doc_id", "text_key", "label", "own", "size", "least", "block")

    # blocks: windows over the places of the template's words, in units of the block's length
    c, o = candidates.alias("c"), own.select("doc_id", "text_key", "hits").dropDuplicates(["doc_id", "text_key"]).alias("o")
    both = c.join(o, F.col("c.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("c.text_key") == F.col("o.text_key")))
    placed = both.select("c.doc_id", "c.text_key", "label", "own", "size", "least", "block", F.inline("o.hits")).where(F.array_contains("own", F.col("word")))
    placed = placed.select("doc_id", "text_key", "label", "size", "least", "block", "word", F.col("at").cast("long").alias("start"), (F.col("at") / F.col("block")).alias("at"))
    block = "collect_set(word) OVER (PARTITION BY doc_id, text_key, label ORDER BY at RANGE BETWEEN CURRENT ROW AND 0.999999D FOLLOWING)"
    found = placed.select("doc_id", "text_key", "label", "size", "least", "block", "start", F.expr(f"size({block})").alias("shared")).where("shared >= least")
    best = found.groupBy("doc_id", "text_key", "label").agg(F.max(F.struct("shared", (-F.col("start")).alias("back"))).alias("b"), F.first("size").alias("size"), F.first("block").cast("long").alias("block"))
    return best.select("doc_id", "text_key", "label", (F.col("b.shared") / F.col("size")).alias("containment"), (-F.col("b.back")).alias("start"), "block")


def unsurpassed(found: Column) -> Column:
    """Of the labels (label, containment, start, block) of a document, those whose best block meets none of a greater containment.

    Passages of one family share most of their words, so a block often holds enough of several; its label is the fullest.
    """
    meets = lambda x, o: (o["start"] < x["start"] + x["block"]) & (x["start"] < o["start"] + o["block"])
    return F.filter(found, lambda x: ~F.exists(found, lambda o: (o["containment"] > x["containment"]) & meets(x, o)))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: word count, base phrase places and labels, labels of templates found, score."""
    rows = materialize(text_words(docs, templates), "license-words")
    found = containment_join(rows, templates, threshold)
    listed = F.collect_list(F.struct("label", "containment", "start", "block"))  # as many as templates at most
    found = found.groupBy("doc_id", "text_key").agg(listed.alias("all"), F.max("containment").alias("best"))
    found = found.select("doc_id", "text_key", F.transform(unsurpassed(F.col("all")), lambda x: x["label"]).alias("found"), "best")
    base = rows.select("doc_id", "text_key", "n_words", "places")
    joined = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_key") == F.col("f.text_key")), "left")
    labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    n_base = F.size("places").cast("long")
    return joined.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op2_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows by counting each template's words in each block of each text, and each phrase at each place."""
    sets = [(label, words_of(text), block_size(text)) for label, text in templates]
    rows = ", ".join(f"('{label}', [{', '.join(repr(w) for w in s)}], {len(s)}, {needed(len(s), threshold)}, {b})" for label, s, b in sets)
    places = " UNION ALL ".join(
        "SELECT k, '" + label + "' AS label, i - 1 AS pos FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE " + " AND ".join(f"words[i + {j}] = '{p}'" for j, p in enumerate(phrase.split(" ")))
        for phrase, label in PHRASES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM d),
p AS ({places}),
t(label, words, size, least, block) AS (VALUES {rows}),
v AS (SELECT label, size, least, block, unnest(words) AS word FROM t),
o AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
h AS (SELECT o.k, v.label, v.size, v.least, v.block, o.word, o.pos FROM o JOIN v USING (word)),
e AS (SELECT k, label FROM h GROUP BY k, label HAVING count(DISTINCT word) >= max(least)),
g AS (SELECT h.* FROM h JOIN e USING (k, label)),
b AS (SELECT s.k, s.label, s.size, s.least, s.pos, count(DISTINCT x.word) AS shared
  FROM g s JOIN g x ON x.k = s.k AND x.label = s.label AND x.pos >= s.pos AND x.pos < s.pos + s.block GROUP BY ALL),
m AS (SELECT k, label, max(shared) AS top FROM b WHERE shared >= least GROUP BY k, label),
f AS (SELECT b.k, b.label, max(top / size) AS c, min(pos) AS pos, max(block) AS block FROM b JOIN m ON m.k = b.k AND m.label = b.label AND shared = top GROUP BY b.k, b.label),
n AS (SELECT k, label FROM f x WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.k = x.k AND o.c > x.c AND o.pos < x.pos + x.block AND x.pos < o.pos + o.block)),
l AS (SELECT k, label FROM n UNION SELECT k, label FROM p)
SELECT doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
  (SELECT count(*) FROM p WHERE p.k = d.k) AS n_base,
  (SELECT min(pos) FROM p WHERE p.k = d.k) AS first_word,
  (SELECT max(pos) FROM p WHERE p.k = d.k) AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM p WHERE p.k = d.k), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM l WHERE l.k = d.k), '') AS labels,
  CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.k = d.k) THEN 1.0::DOUBLE ELSE coalesce((SELECT max(c) FROM f WHERE f.k = d.k), 0.0::DOUBLE) END AS score
FROM d JOIN w USING (k)"""
