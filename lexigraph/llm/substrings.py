"""Substring deduplication by hashing lines, runs of short lines, sentences of long lines, and paragraphs.

A text is cut into units: within each line, sentences are joined from the left until a unit
has `least_words` words; what is left at the line's end joins the unit before it. A unit is
normalised (lower case, single blanks) and hashed. A line with fewer words is hashed together
with the short lines after it, as many as make `least_words` words, from each short line on,
so a passage in short lines is found wherever it stands; a paragraph (lines up to a blank one)
of several units or short lines is hashed as a whole as well, so it is found in other line
breaks. A letter of a script without blanks between words counts as a word. Of equal units in
the whole corpus the earliest stays: the one in the document with the smallest doc_id (nulls
last; of equal ones that with the least hash of id and text), and there the first, with those
that overlap it. The others are removed, each with the white space
after it; a short line goes only with a run or paragraph that is repeated. Offsets of what is kept refer to the original text, in characters.

Digests are combined before they are shuffled, so a line that a third of all documents share
is as many rows as there are tasks; in the join with its first occurrence it is salted. Only (digest, document, unit number) rows are shuffled to
find the repeats; a document's removed unit numbers, bounded by its own length, then meet its
text.

Defined cases: a null text stays null and has no units; documents without a doc_id come
after all others; rows that repeat doc_id and text are one document; other columns are kept
as they are, those named like an added one as own_<name>; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, join_counted, map_batches, materialize, pieces, whole_text, with_own_names

LEAST_WORDS = 8
_LINE = re.compile(r"[^\n]+")
_SENTENCE_END = re.compile(r"[.!?]+\s+|[\u3002\uff01\uff1f]+\s*")
_NO_BLANKS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def count_words(words: list[str]) -> int:
    """Words between blanks, but each letter of scripts that have no blanks between words."""
    return sum(1 if w.isascii() else max(1, len(_NO_BLANKS.findall(w))) for w in words)


def units(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, str | None]]:
    """(start, end, normalised unit) in order; None stands for a line too short to be a unit. Ends lie before white space."""
    out: list[tuple[int, int, str | None]] = []
    for line in _LINE.finditer(text):
        begin, end = line.span()
        words: list[str] = []
        own: list[tuple[int, int, list[str]]] = []
        at = begin
        for cut in [*(m.end() for m in _SENTENCE_END.finditer(text, begin, end)), end]:
            words += text[at:cut].lower().split()
            at = cut
            if len(words) >= least_words or count_words(words) >= least_words:
                own.append((begin, cut, words))
                begin, words = cut, []
        if words:
            if own:
                own[-1] = (own[-1][0], end, own[-1][2] + words)
            else:
                out.append((begin, end, None))
        out += [(a, b, " ".join(ws)) for a, b, ws in own]
    return out


def hashed(text: str, parts: list[tuple[int, int, str | None]], least_words: int = LEAST_WORDS) -> list[tuple[int, int, str]]:
    """(first part, last part, normalised text) of all that is hashed: units, runs of short lines, paragraphs."""
    out = [(i, i, unit) for i, (_, _, unit) in enumerate(parts) if unit is not None]
    own = [text[a:b].lower().split() if unit is None else [] for a, b, unit in parts]
    sizes = [count_words(w) for w in own]
    total, last = 0, -1
    for i, (_, _, unit) in enumerate(parts):
        if unit is not None:
            continue
        if last < i:
            total, last = sizes[i], i
        while total < least_words and last + 1 < len(parts) and parts[last + 1][2] is None:
            last += 1
            total += sizes[last]
        if total >= least_words:
            out.append((i, last, " ".join([w for ws in own[i : last + 1] for w in ws])))
        total -= sizes[i]
    first = 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or _BLANK_LINE.search(text, parts[i - 1][1] - 1, parts[i][0] + 1):
            words = text[parts[first][0] : parts[i - 1][1]].lower().split() if i - first > 1 else []
            if words and count_words(words) >= least_words:
                out.append((first, i - 1, " ".join(words)))
            first = i
    return sorted(set(out))


def keep(text: str, gone: set[int], least_words: int = LEAST_WORDS) -> tuple[str, list[tuple[int, int]], int, int]:
    """The text without what is hashed under these numbers, the spans kept, and the numbers of units and short lines there and hashed away."""
    parts = units(text, least_words)
    flags = [False] * len(parts)
    if gone:
        for n, (first, last, _) in enumerate(hashed(text, parts, least_words)):
            if n in gone:
                flags[first : last + 1] = [True] * (last + 1 - first)
    own = sum(flags)
    spans, at = [], 0
    for i, flag in enumerate(flags):
        if flag:
            if parts[i][0] > at:
                spans.append((at, parts[i][0]))
            at = parts[i + 1][0] if i + 1 < len(parts) else len(text)
    if at < len(text):
        spans.append((at, len(text)))
    return "".join(text[a:b] for a, b in spans), spans, len(parts), own


def _row_key():
    return F.xxhash64("doc_id", whole_text())


def unit_digests(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, row_key, number among what is hashed, two digests, and whether the document has the same before, apart from it."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("unit", pa.int32()), ("digest", pa.int64()), ("check", pa.int32()), ("again", pa.bool_())])

    def run(batches):
        import xxhash

        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for doc_id, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                    seen: dict[int, int] = {}
                    for i, (first, last, unit) in enumerate(hashed(text, units(text, least_words), least_words) if text else ()):
                        h = xxhash.xxh3_128_intdigest(unit)
                        out.append((doc_id, key, i, (h & 0xFFFFFFFFFFFFFFFF) - 2**63, (h >> 64 & 0xFFFFFFFF) - 2**31, seen.setdefault(h, last) < first))
                columns = list(zip(*out)) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, row_key long, unit int, digest long, check int, again boolean")


def removed_units(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row_key and the numbers of its removed units, for every document that loses one."""
    keys = ["digest", "check"]
    rows = materialize(unit_digests(docs, least_words).withColumn("rank", F.coalesce("doc_id", F.lit(2**63 - 1))).drop("doc_id"), "units")
    firsts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rank").alias("first_rank")).where("n > 1")
    met = materialize(join_counted(rows, materialize(firsts, "unit-firsts"), keys, "n").select("row_key", "unit", *keys, "again", "rank", "first_rank"), "unit-repeats")
    late = met.where(F.col("again") | (F.col("rank") > F.col("first_rank"))).select("row_key", "unit")
    # documents that share the least rank (a repeated id, or none at all) go by their rows' hashes
    first = met.where("rank = first_rank")
    tied = first.groupBy(*keys).agg(F.min("row_key").alias("first_row"), F.count("*").alias("n"), (F.min("row_key") < F.max("row_key")).alias("several")).where("several")
    later = join_counted(first.select("row_key", "unit", *keys), tied.select(*keys, "first_row", "n"), keys, "n").where("row_key > first_row").select("row_key", "unit")
    return late.union(later).groupBy("row_key").agg(F.collect_set("unit").alias("gone"))


ADDED = ("n_units", "n_removed", "removed_chars", "kept_spans")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated units taken out of text, and n_units, n_removed, removed_chars, kept_spans added."""
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))]
    extra = [T.StructField(c, k) for c, k in zip(ADDED, kinds)]
    docs = with_own_names(docs, ADDED).withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    gone = removed_units(docs, least_words).select(F.col("row_key").alias("_lx_key"), F.col("gone").alias("_lx_gone"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    joined = docs.withColumn("_lx_row", _row_key()).join(gone, F.col("_lx_row") == F.col("_lx_key"), "left").select(*(f"`{c}`" for c in names), "_lx_gone")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts, more = [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("_lx_gone").to_pylist()):
                    own = set(own or ())
                    kept, spans, n, removed = keep(text or "", own, least_words)
                    texts.append(None if text is None else kept)
                    more.append((n, removed, len(text or "") - len(kept), [{"start": a, "end": b} for a, b in spans]))
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[i] for m in more], pa.int64()) for i in range(3)), pa.array([m[3] for m in more], span)], names=[*names, *(f.name for f in extra)])

    return map_batches(joined, run, T.StructType([*docs.schema.fields, *extra]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_units", "n_removed", "removed_chars", "kept_spans", "text")
