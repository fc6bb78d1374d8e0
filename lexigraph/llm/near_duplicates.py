"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is kept as `bands * rows` registers: shingle hashes are
dealt to buckets, and of the least remainder in a bucket the count of leading zeros (6 bits)
and the next 10 bits are kept; a register without a shingle stays empty. Bands of registers
(an empty one borrows another's value for this, by a fixed chain of probes) are hashed to
buckets; documents that share one are candidates. Their Jaccard similarity is estimated from
equal registers less the expected collisions; what may reach the threshold is verified on the
full shingle sets.

With 36 bands of 5 registers, a pair at similarity 0.8 is missed with a chance of 6e-7. The
estimate discards a pair if it is more than `slack` standard deviations (of as many registers
as either set fills) under the threshold, so of small sets, which fill few, it discards none.

Equal sets are one class, so exact copies cost one row. In a bucket, not all pairs are made:
a star joins all members to one centre, verified stars are turned into components, a second
star from another centre follows, and only members of a bucket that are then still in
different components are compared with one another, where exact bounds on what they can share
leave room for a link. Joins on buckets, shingles, classes and centres are salted where one is
hot, and a large bucket's last comparison is dealt into tiles by bands of set sizes and blocks of members.

Defined cases: null or blank texts have no shingles and stay alone; a text with fewer words
than a shingle has its words as one shingle; rows that repeat doc_id and text are one
document; a component's id is its smallest doc_id that is not null, and where all are null the
document with the least hash of its text is kept; other columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, is_small, join_counted, map_batches, materialize, mix64, pieces, text_bytes, whole_text, word_hashes, word_spans
from .components import merged

BANDS, ROWS, THRESHOLD_PERCENT, SLACK = 36, 5, 80, 7.0
RARE, PARTS, BLOCK = 10, 64, 2000
MANTISSA_BITS, EMPTY = 10, 0xFFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each begins."""
    data, offsets = text_bytes(column)
    start, end, first = word_spans(data, offsets)
    hashes = word_hashes(data, start, end)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words if len(rolled) else 0):
        rolled = rolled * _STEP + hashes[j : n - words + 1 + j]
    rolled = mix64(rolled)
    sets, sizes = [], np.zeros(len(column), np.int64)
    for i in range(len(column)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            own = np.unique(rolled[a : b - words + 1])
        elif b > a:
            own = np.full(1, b - a, np.uint64)
            for x in hashes[a:b]:
                own = mix64(own * _STEP + x)
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def registers(sets: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """A row of `count` registers for each sorted set; those of buckets without a member are EMPTY."""
    docs = len(first) - 1
    out = np.full((docs, count), EMPTY, np.uint16)
    if not len(sets):
        return out
    doc = np.repeat(np.arange(docs), np.diff(first))
    high, low, n = sets >> np.uint64(32), sets & np.uint64(0xFFFFFFFF), np.uint64(count)
    bucket = ((high * n + (low * n >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)  # the part of hash * count above 64 bits
    new = np.ones(len(sets), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    least = sets[new] * n  # the part below: where in its bucket the least member lies
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))  # exact, of 53 bits
    zeros = np.clip(53 - exponent, 0, 62).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out[doc[new], bucket[new]] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers in which each empty one has the value of another, the same probes for all rows; rows without any stay empty."""
    out, count = regs.copy(), regs.shape[1]
    there = regs != EMPTY
    d, j = np.nonzero(~there & there.any(1)[:, None])
    turn = 0
    while len(d):
        turn += 1
        probe = (mix64(np.arange(count, dtype=np.uint64) * np.uint64(7919) + np.full(1, turn, np.uint64) * _STEP) % np.uint64(count)).astype(np.int64)
        ok = there[d, probe[j]]
        out[d[ok], j[ok]] = regs[d[ok], probe[j[ok]]]
        d, j = d[~ok], j[~ok]
    return out


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of each row."""
    parts = filled(regs).reshape(len(regs), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for i in range(parts.shape[2]):
        key = mix64(key * _STEP + parts[:, :, i].astype(np.uint64))
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id (equal for equal sets, null for empty ones), registers, keys of bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("class_id", pa.int64()), ("registers", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        import xxhash

        for batch in batches:
            for part in pieces(batch, "text"):
                sets, first = shingle_sets(part.column("text"), words)
                regs = registers(sets, first, bands * rows)
                ids = [int.from_bytes(xxhash.xxh3_64_digest(sets[a:b].tobytes()), "little", signed=True) if b > a else None for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(np.diff(first)), pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(regs) + 1) * bands, pa.int32()), pa.array(band_keys(regs, bands).ravel()))], schema=schema)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), F.col("text").cast("string").alias("text"))
    return map_batches(text, run, "doc_id long, text_key long, n_shingles long, class_id long, registers binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class_id and the whole shingle set of the wanted (doc_id, text_key, class_id)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), F.col("text").cast("string").alias("text"))
    a, b = keyed.alias("a"), wanted.alias("b")
    texts = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))).select("class_id", "text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets, first = shingle_sets(part.column("text"), words)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("class_id"), lists], names=["class_id", "shingles"])

    return map_batches(texts, run, "class_id long, shingles array<long>").dropDuplicates(["class_id"])


def expected_collisions(n: np.ndarray, m: np.ndarray, count: int) -> np.ndarray:
    """Registers of disjoint sets of n and m members that are expected to be equal by chance.

    The least of n uniform members in a bucket of width 1 / count has the density n (1 - x)^(n - 1); two are in one
    cell of width w at x with chance w times the product of both, summed over the cells of each count of zeros.
    """
    n, m = np.asarray(n, np.float64), np.asarray(m, np.float64)
    power, out = n + m - 1, np.zeros(np.broadcast(n, m).shape)
    for zeros in range(63):
        low, high = 2.0 ** -(zeros + 1) / count, 2.0**-zeros / count
        mass = np.exp(power * np.log1p(-low)) - np.exp(power * np.log1p(-min(high, 1 - 1e-16)))
        out += (high - low) * 2.0**-MANTISSA_BITS * n * m / power * mass
    return count * out


def estimate(r_a: np.ndarray, r_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of registers, and the number of registers that either fills."""
    either = np.maximum(1, ((r_a != EMPTY) | (r_b != EMPTY)).sum(1))
    equal = ((r_a == r_b) & (r_a != EMPTY)).sum(1)
    chance = np.minimum(0.9, expected_collisions(n_a, n_b, r_a.shape[1]) / either)
    return (equal / either - chance) / (1 - chance), either


def _sides(pairs: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """pairs (a written table) with columns of both their classes, a centre of many pairs salted."""
    few, slim = is_small(pairs), pairs.select("a", "b")
    for c in ("a", "b"):
        own = classes.select(F.col("class_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))
        times = slim.groupBy(c).agg(F.count("*").alias("times"))
        pairs = pairs.join(own, c) if few else join_counted(pairs, own.join(times, c), [c], "times").drop("times")
    return pairs


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int, count: int, slack: float = SLACK) -> DataFrame:
    """Of pairs (a, b), those whose sizes and estimated similarity may reach the threshold."""
    sized = _sides(pairs, classes, "n_shingles", "registers").where(100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_shingles_a", "n_shingles_b"))
            r_a, r_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, count) for c in ("registers_a", "registers_b"))
            similarity, either = estimate(r_a, r_b, n_a, n_b)
            t = percent / 100
            keep = pa.array(similarity >= t - slack * np.sqrt(t * (1 - t) / either))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return map_batches(sized.select("a", "b", "n_shingles_a", "n_shingles_b", "registers_a", "registers_b"), run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union of their full sets."""
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    met = _sides(pairs, sets, "shingles")
    return met.where(100 * both >= percent * (F.size("shingles_a") + F.size("shingles_b") - both)).select("a", "b")


def _ordered(a: str, b: str) -> tuple:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _reaches(shared, n_a, n_b, percent: int):
    """Whether sets of these sizes with at most so many shared members can reach the threshold."""
    return 100 * shared >= percent * (n_a + n_b - shared)


def tiles(rows: DataFrame, percent: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """rows (bucket, class_id, n and more) twice, with a column `tile` in which each two rows of a bucket meet exactly once in either order, if their sizes allow a link.

    Sizes n are in bands as wide as the threshold lets linked sizes differ, so only bands side by side meet. The members of a
    bucket are dealt into blocks of about `block`; a tile is a band, a block of the first and one of the second.
    """
    crowd = materialize(rows.groupBy("bucket").agg(F.count("*").alias("members")), "nd-crowds")
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = join_counted(rows, crowd, ["bucket"], "members").withColumn("blocks", blocks).drop("members")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101 / percent))).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = F.transform(every, lambda j: F.struct(F.col("band").alias("band"), F.col("own").alias("i"), j.alias("j")))
    second = F.flatten(F.transform(every, lambda i: F.transform(F.array(*[F.col("band") + d for d in (-1, 0, 1)]), lambda band: F.struct(band.alias("band"), i.alias("i"), F.col("own").alias("j")))))
    return tuple(dealt.withColumn("tile", F.explode(x)).drop("blocks", "own", "band") for x in (first, second))


def open_pairs(placed: DataFrame, sets: DataFrame, percent: int, rare: int = RARE, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of classes that share a bucket, are in different components, and can reach the threshold.

    Exact bounds discard the others before they are made. A shingle is rare if at most `rare`
    of the classes still open have it. Pairs with a rare shingle in common are found through it,
    at most rare / 2 for each of a class's shingles, and counted. Without one, two classes share
    at most the sum, over parts of the shingles' hash range, of the lesser number of common
    shingles each has there.
    """
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).where("x < y").select("bucket", "members")
    left = materialize(join_counted(placed, materialize(mixed, "nd-mixed"), ["bucket"], "members").select("bucket", "class_id", "component"), "nd-open")
    classes = left.groupBy("class_id").agg(F.min("component").alias("component"))
    each = materialize(sets.join(classes, "class_id").select("class_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "nd-open-shingles")
    times = materialize(each.groupBy("shingle").agg(F.count("*").alias("times")), "nd-open-times")
    marked = join_counted(each, times, ["shingle"], "times").withColumn("seen", F.when(F.col("times") <= rare, F.col("times"))).drop("times")
    marked = materialize(marked, "nd-marked")
    part = F.pmod("shingle", F.lit(parts))
    common = F.col("seen").isNull()
    sizes = marked.groupBy("class_id").agg(F.first("n").alias("n"), F.count_if(common).cast("int").alias("common"), F.array(*[F.count_if(common & (part == i)).cast("int") for i in range(parts)]).alias("held"))
    sizes = materialize(sizes, "nd-sizes")

    side = marked.where("seen > 1").select("shingle", "class_id", "component", "n")
    other = side.select("shingle", F.col("class_id").alias("other"), F.col("component").alias("other_component"), F.col("n").alias("other_n"))
    met = side.join(other, "shingle").where((F.col("component") < F.col("other_component")) & (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")))
    met = met.groupBy("class_id", "other").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("other_n").alias("other_n"))
    has = lambda c, name: sizes.select(F.col("class_id").alias(c), F.col("common").alias(name))
    met = met.join(has("class_id", "k"), "class_id").join(has("other", "other_k"), "other")
    met = met.where(_reaches(F.col("shared") + F.least("k", "other_k"), F.col("n"), F.col("other_n"), percent)).select(*_ordered("class_id", "other"))

    one, two = tiles(materialize(left.join(sizes, "class_id").where(_reaches(F.col("common"), F.col("n"), F.col("common"), percent)), "nd-near"), percent, block)
    two = two.select("bucket", "tile", *(F.col(c).alias(f"other_{c}") for c in ("class_id", "component", "n", "common", "held")))
    least = F.aggregate(F.zip_with("held", "other_held", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    cheap = _reaches(F.least("common", "other_common"), F.col("n"), F.col("other_n"), percent)
    fits = F.when((F.col("component") < F.col("other_component")) & cheap, _reaches(least, F.col("n"), F.col("other_n"), percent)).otherwise(False)
    near = one.join(two, ["bucket", "tile"]).where(fits).select(*_ordered("class_id", "other_class_id"))
    return met.union(near).distinct()


def near_duplicates(docs: DataFrame, words: int, percent: int = THRESHOLD_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    count = bands * rows
    signed = materialize(signatures(docs, words, bands, rows), "nd-signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n_shingles"))
    classes = signed.where("class_id is not null").groupBy("class_id").agg(best.alias("rep"), F.count("*").alias("times"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("class_id", "times", "rep.doc_id", "rep.text_key", "rep.n_shingles", "registers", "bands"), "nd-classes")

    keys = classes.select("class_id", F.explode("bands").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("n > 1")
    buckets = materialize(buckets, "nd-buckets")
    members = materialize(join_counted(keys, buckets.select("bucket", "n"), ["bucket"], "n").select("bucket", "class_id"), "nd-members")

    wanted = members.select("class_id").distinct()
    few = materialize(classes.drop("bands").join(wanted, "class_id", "left_semi"), "nd-candidates")
    sets = materialize(full_sets(docs, few.select("class_id", "doc_id", "text_key"), words), "nd-sets")

    tried = None
    parts = few.select(F.col("class_id").alias("node"), F.col("class_id").alias("component"))
    for turn in ("low", "high", "all"):
        placed = members.join(parts, members["class_id"] == parts["node"], "left").select("bucket", "class_id", F.coalesce("component", "class_id").alias("component"))
        if turn == "all":
            pairs = open_pairs(placed, sets, percent)
        else:
            # a class is the centre of no more buckets than there are bands; of each bucket, the centre and its component
            centres = buckets.join(parts, buckets[turn] == parts["node"], "left").select("bucket", "n", F.col(turn).alias("centre"), F.coalesce("component", turn).alias("centre_component"))
            starred = join_counted(placed, centres, ["bucket"], "n").where(F.col("centre_component") != F.col("component"))
            pairs = starred.select(*_ordered("class_id", "centre")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "nd-pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = materialize(verified(materialize(likely_pairs(pairs, few, percent, count), "nd-likely"), sets, percent), "nd-links")
        parts = merged(parts, found)

    whole = classes.join(parts, classes["class_id"] == parts["node"], "left").select("class_id", "times", "doc_id", "text_key", F.coalesce("component", "class_id").alias("component"))
    whole = materialize(whole, "nd-whole")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    smallest = whole.groupBy("component").agg(least.alias("rep"), F.count("*").alias("n")).select("component", "n", F.col("rep.doc_id").alias("component_id"), F.col("rep.text_key").alias("rep_key"))
    named = join_counted(whole.select("class_id", "times", "component"), smallest, ["component"], "n").select("class_id", "times", "component_id", "rep_key")
    named = materialize(named, "nd-components")
    out = join_counted(signed.select("doc_id", "text_key", "n_shingles", "class_id"), named, ["class_id"], "times", "left")
    component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component) & (component.isNotNull() | F.col("class_id").isNull() | (F.col("text_key") == F.col("rep_key")))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2).select("doc_id", "n_shingles", "component_id", "kept")
