"""Code-graph documents of any size, read in pieces by many tasks.

A multi-line JSON document is one row of one task to Spark's reader. Here a file is read in
pieces that end at a closing brace, wherever its splits lie. A first pass counts quotes and
levels of each split, from which follows in what state each begins; a second one puts the
documents together that lie within a split, and Spark parses them as they are. Of a document
that is long or lies across splits, running sums over the pieces of a split, and over the splits
of a file, tell how deep each token stands, and which object and key it belongs to; each member
and each call becomes a row of its own, so neither such a document nor a community has to fit
into one.

Defined cases: a file may hold several documents, one after the other or in an array; unknown
keys and whatever stands below them are passed over; a label may follow its members; of a key
that an object has twice the last counts; members and calls without a known key are passed over;
an empty file gives no rows. Text that is not JSON gives rows of no meaning.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scratch import bound_batches, stored
from ..schema import CODE_GRAPH

#: Files above this are read in pieces, and documents above this are cut into rows.
MOST_WHOLE = 16 << 20
#: Up to so many documents travel to their members, beyond that they are joined by a shuffle.
MOST_DOCUMENTS = 100_000
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf'{_STRING}(?:\s*:)?|[{{}}\[\]]|[^\s{{}}\[\]:,"]+'
_PLACE = ["file", "block"]


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows (file, block and more) with running sums, and last values that are not null, from the file's begin to each row.

    Rows are sorted within a block (a split of a file) only; what lies before a block is taken from totals of blocks.
    """
    lasts = lasts or {}
    own = Window.partitionBy(*_PLACE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    latest = {n: F.max(F.when(c.isNotNull(), F.struct(*order, c.alias("_v")))).getField("_v") for n, c in lasts.items()}
    blocks = rows.groupBy(*_PLACE).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()), *(c.alias(n) for n, c in latest.items()))
    carried = blocks.select(*_PLACE, *(F.coalesce(F.sum(n).over(past), F.lit(0)).alias(f"_{n}") for n in sums), *(F.last(n, ignorenulls=True).over(past).alias(f"_{n}") for n in lasts))
    here = rows.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(n) for n, c in sums.items()), *(F.last(c, ignorenulls=True).over(own).alias(n) for n, c in lasts.items()))
    joined = here.join(carried, _PLACE)
    whole = {**{n: F.col(n) + F.col(f"_{n}") for n in sums}, **{n: F.coalesce(n, f"_{n}") for n in lasts}}
    return joined.withColumns(whole).drop(*(f"_{n}" for n in whole))


# Quotes and levels, in tasks ----------------------------------------------------------------

_KIND, _STEP = np.zeros(256, np.uint8), np.array([0, 0, 1, -1])
for _signs, _kind in ((b'"', 1), (b"{[", 2), (b"}]", 3)):
    _KIND[list(_signs)] = _kind


def _cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of pieces, and where each begins and the last ends."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _lexed(column: pa.Array, begins: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Quotes up to the end of each piece, and levels opened less those closed by then with the brace that ends it.

    The levels are those outside strings, for each way in which the first piece may begin: outside a string 0, inside 1.
    """
    data, ends = _cut(column)
    if (data == 0x5C).any():
        data = np.frombuffer(re.sub(rb"\\.", b"  ", data.tobytes(), flags=re.S), np.uint8)
    kind = _KIND[data]
    at = np.flatnonzero(kind)
    kind, n = kind[at], np.searchsorted(at, ends[1:])
    quotes = np.cumsum(kind == 1)
    seen = np.concatenate([[0], quotes])[n]
    deep = lambda inside: np.concatenate([[0], np.cumsum(_STEP[kind] * ((quotes + inside) % 2 == 0))])[n] - np.cumsum((seen + inside) % 2 == 0)
    return seen, [deep(i) for i in begins]


def _runs(batch: pa.RecordBatch):
    """The first row and the number of rows of each split's rows in a batch."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    at = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    bounds = [0, *at.tolist(), batch.num_rows] if batch.num_rows else [0]
    return zip(bounds, np.diff(bounds).tolist())


def _totals(batches):
    """A row a split: whether it has an odd number of quotes, its levels if it begins outside a string and if inside, whether it begins with [."""
    place, odd, deep, first = None, 0, [0, 0], b""
    row = lambda: pa.RecordBatch.from_pydict({"file": [place[0]], "block": [place[1]], "odd": [int(odd)], "outer": [int(deep[0])], "inner": [int(deep[1])], "listed": [int(place[1] == 0 and first == b"[")]})
    for batch in batches:
        for i, n in _runs(batch):
            text, own = batch.column("text").slice(i, n), (batch.column("file")[i].as_py(), batch.column("block")[i].as_py())
            if own != place:
                if place:
                    yield row()
                place, odd, deep, first = own, 0, [0, 0], b""
            first = first or _cut(text)[0].tobytes().lstrip()[:1]
            seen, levels = _lexed(text, (0, 1))
            deep = [deep[h] + levels[h ^ odd][-1] for h in (0, 1)]
            odd ^= int(seen[-1]) & 1
    if place:
        yield row()


def _joined(pieces: pa.Array, last: np.ndarray) -> pa.Array:
    """Texts of pieces with their braces, each up to one of the pieces `last`; no piece is beyond the last of these."""
    data, ends = _cut(pieces)
    braces = ends[1:] + np.arange(len(pieces))
    out, own = np.full(len(data) + len(pieces), ord("}"), np.uint8), np.ones(len(data) + len(pieces), bool)
    own[braces] = False
    out[own] = data
    wide = np.int64 if pa.types.is_large_string(pieces.type) else np.int32
    offsets = np.concatenate([[0], braces[last] + 1]).astype(wide)
    return pa.Array.from_buffers(pieces.type, len(last), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _documents_of(most: int):
    """Of splits' pieces: texts of whole documents up to so many bytes, and the pieces of others with their place and state."""

    def whole(texts):
        none = lambda t: pa.nulls(len(texts), t)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int64()), texts, none(pa.bool_())], _PART)

    def pieces(place, nth, texts, inside):
        at = [pa.array(np.full(len(texts), v), pa.int64()) for v in place]
        return pa.RecordBatch.from_arrays([*at, pa.array(np.arange(nth, nth + len(texts)), pa.int64()), texts, pa.array(inside, pa.bool_())], _PART)

    def run(batches):
        place, base, inside, depth, nth, broken, kept, size = None, 0, 0, 0, 0, False, [], 0
        for batch in batches:
            for i, n in _runs(batch):
                text, own = batch.column("text").slice(i, n), (batch.column("file")[i].as_py(), batch.column("block")[i].as_py())
                if own != place:
                    yield from (pieces(place, *k) for k in kept)  # of a document that goes on in the next split
                    place, nth, kept, size = own, 0, [], 0
                    base, inside, depth = (batch.column(c)[i].as_py() for c in ("base", "inside", "depth"))
                    broken = bool(inside) or depth > base
                seen, (deep,) = _lexed(text, (inside,))
                within = (seen + inside) % 2
                begins = np.concatenate([[inside], within[:-1]]) == 1
                last = np.flatnonzero((within == 0) & (depth + deep <= base))
                at = 0
                if len(last) and (broken or kept):  # the end of a document that an earlier batch or split began
                    at = int(last[0]) + 1
                    kept.append((nth, text.slice(0, at), begins[:at]))
                    size += _cut(text.slice(0, at))[1][-1] + at
                    if broken or size > most:
                        yield from (pieces(place, *k) for k in kept)
                    else:
                        yield whole(_joined(pa.concat_arrays([k[1] for k in kept]), np.array([sum(len(k[1]) for k in kept) - 1])))
                    broken, kept, size, last = False, [], 0, last[1:]
                if len(last):
                    end = int(last[-1]) + 1
                    texts = _joined(text.slice(at, end - at), last - at)
                    sizes = np.diff(_cut(texts)[1])
                    if (sizes <= most).all():
                        yield whole(texts)
                    else:
                        for j, to in enumerate(last.tolist()):
                            yield whole(texts.slice(j, 1)) if sizes[j] <= most else pieces(place, nth + at, text.slice(at, to + 1 - at), begins[at : to + 1])
                            at = to + 1
                    at = end
                if at < n:
                    kept.append((nth + at, text.slice(at), begins[at:]))
                    size += _cut(text.slice(at))[1][-1] + n - at
                    if broken or size > most:
                        yield from (pieces(place, *k) for k in kept)
                        broken, kept, size = True, [], 0
                inside, depth, nth = int(within[-1]), depth + int(deep[-1]), nth + n
        yield from (pieces(place, *k) for k in kept)

    return run


_PART = ["file", "block", "nth", "text", "inside"]


def _parts(spark: SparkSession, path: str | list[str], most: int) -> DataFrame:
    """graph, a whole document parsed, or file, block, nth, text, inside of a piece of one that is long or lies across splits; (block, nth) is the order in a file."""
    bound_batches(spark)
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    totals = stored(raw.mapInArrow(_totals, "file long, block long, odd long, outer long, inner long, listed long"), "graph-splits")
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = totals.withColumn("inside", (F.coalesce(F.sum("odd").over(past), F.lit(0)) % 2).cast("int"))
    splits = splits.withColumn("deep", F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner")))
    splits = splits.select(*_PLACE, "inside", F.coalesce(F.sum("deep").over(past), F.lit(0)).alias("depth"), F.max("listed").over(Window.partitionBy("file")).alias("base"))
    parts = raw.join(F.broadcast(splits), _PLACE).mapInArrow(_documents_of(most), "file long, block long, nth long, text string, inside boolean")
    whole = F.when(F.col("nth").isNull(), F.ltrim(F.col("text"), F.lit(" \t\r\n,[]")))
    return stored(parts.select(*_PLACE, "nth", F.when(F.col("nth").isNotNull(), F.col("text")).alias("text"), "inside", F.from_json(whole, CODE_GRAPH).alias("graph")), "graph-parts")


# Tokens of documents that are long or lie across splits ------------------------------------------


def _tokens(pieces: DataFrame) -> DataFrame:
    """file, block, unit, pos, token of the JSON tokens of pieces; a key has its colon; (unit, pos) is the order in a file."""
    # a piece that begins inside a string goes on from the one before
    units = running(pieces, ["nth"], {"unit": F.when(~F.col("inside"), 1)}).groupBy("file", "unit")
    units = units.agg(F.min("block").alias("block"), F.sort_array(F.collect_list(F.struct("block", "nth", "text"))).alias("parts"))
    text = F.concat(F.array_join(F.col("parts.text"), "}"), F.lit("}"))
    return units.select(*_PLACE, "unit", F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))


def _plain(token: Column) -> Column:
    """The value of a JSON string, number or literal."""
    simple = token.startswith('"') & ~token.contains("\\")
    return F.when(simple, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0])


def _values(pieces: DataFrame) -> DataFrame:
    """Values of objects at the depths of documents, communities and calls, and members, with numbers of these and their keys."""
    token = F.col("token")
    opens, closes = token.isin("{", "["), token.isin("}", "]")
    tokens = stored(_tokens(pieces), "graph-tokens")
    first = F.when((F.col("unit") == 1) & (F.col("pos") == 0), (token == "[").cast("int"))
    deep = running(tokens, ["unit", "pos"], {"depth": F.when(opens, 1).when(closes, -1)}, {"base": first})
    depth = F.col("depth") - F.col("base")
    known = stored(deep.withColumn("depth", depth).where(F.col("depth").isin(1, 3, 5) & (~opens & ~closes | (token == "{"))).drop("base"), "graph-depths")
    is_key = token.endswith(":")
    begins = lambda n: F.when((token == "{") & (F.col("depth") == n), 1)
    own_key = lambda n: F.when(is_key & (F.col("depth") == n), _plain(F.regexp_replace(token, r"\s*:$", "")))
    numbered = running(known, ["unit", "pos"], {"document": begins(1), "object": begins(3), "member": begins(5)}, {"key_1": own_key(1), "key_3": own_key(3), "key_5": own_key(5)})
    listed = F.col("key_1") == "communities"
    wanted = ((F.col("depth") == 1) & (F.col("key_1") == "source")) | ((F.col("depth") == 3) & (listed & (F.col("key_3") == "label") | (F.col("key_1") == "calls") & F.col("key_3").isin("from", "to"))) | ((F.col("depth") == 5) & listed & (F.col("key_3") == "members") & F.col("key_5").isin("kind", "name", "file"))
    values = numbered.where((token != "{") & ~is_key & wanted)
    name = F.when(F.col("depth") == 1, "source").when(F.col("depth") == 3, F.col("key_3")).otherwise(F.col("key_5"))
    return stored(values.select("file", "document", "object", "member", "depth", "unit", "pos", name.alias("name"), _plain(token).alias("value")), "graph-values")


def code_graph_pieces(spark: SparkSession, path: str | list[str], most: int = MOST_WHOLE) -> DataFrame:
    """Code-graph exports as `code_graph_export` reads them, but long documents, and those across splits, with one member or one call a row."""
    parts, none = _parts(spark, path, most), F.lit(None).cast("string").alias("repo")
    whole = parts.where("nth is null and (graph.communities is not null or graph.calls is not null)").select(none, "graph.source", "graph.communities", "graph.calls")
    pieces = parts.where("nth is not null").select(*_PLACE, "nth", "text", "inside")
    if pieces.isEmpty():
        return whole
    values = _values(pieces)
    last = lambda name: F.max(F.when(F.col("name") == name, F.struct("unit", "pos", "value"))).getField("value").alias(name)
    documents = values.where("depth = 1").groupBy("file", "document").agg(last("source"))
    if documents.limit(MOST_DOCUMENTS + 1).count() <= MOST_DOCUMENTS:
        documents = F.broadcast(documents)
    labels = values.where("depth = 3 and name = 'label'").groupBy("file", "object").agg(last("label"))
    member = values.where("depth = 5").groupBy("file", "document", "object", "member").agg(last("kind"), last("name"), last("file").alias("of_file"))
    call = values.where("depth = 3 and name <> 'label'").groupBy("file", "document", "object").agg(last("from"), last("to"))
    types = dict(spark.createDataFrame([], CODE_GRAPH).dtypes)
    of = F.struct("kind", "name", F.col("of_file").alias("file"))
    members = member.join(labels, ["file", "object"], "left").join(documents, ["file", "document"], "left")
    members = members.select("source", F.array(F.struct("label", F.array(of).alias("members"))).alias("communities"), F.lit(None).cast(types["calls"]).alias("calls"))
    calls = call.join(documents, ["file", "document"], "left").select("source", F.lit(None).cast(types["communities"]).alias("communities"), F.array(F.struct("from", "to")).alias("calls"))
    return whole.unionByName(members.unionByName(calls).select(none, "source", "communities", "calls"))


def code_graphs(spark: SparkSession, path: str, most: int = MOST_WHOLE) -> DataFrame:
    """Code-graph exports: documents of small files as they are, larger files in pieces."""
    from .files import code_graph_export

    sizes = spark.read.format("binaryFile").load(path).select("length")
    return code_graph_pieces(spark, path, most) if sizes.where(F.col("length") > most).limit(1).count() else code_graph_export(spark, path)
