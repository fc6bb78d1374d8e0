"""Quality rules: base counts, and robust multivariate outliers.

For each (language, source) cell a minimum-covariance-determinant estimate of the location
and scatter of transformed text statistics is made over all its documents. From several
deterministic starts (medians and quartile spreads alone, and with the correlations of spatial
signs and of bounded scores) concentration steps keep the share `support` of the rows with the
least Mahalanobis distance and estimate anew from them, until determinants fall by less than
`tolerance` on average (or `most_steps`); of each cell's starts the one with the least determinant stays. Each step is
two aggregations over slim rows, combined before they are shuffled, so a cell with a third of
all rows is no heavier than its tasks; estimates of cells are few and meet the rows by
broadcast, behind a count.

One rule serves cells of all sizes: a cell's moments are joined by those of its language as if
these were `prior` more rows, a language's by those of all documents in the same way, and these
by independent features with all rows' medians and quartile spreads, so a small cell is judged
mostly by its language and a large one by itself.

Documents are rejected whose squared distance is beyond a fence: on a logarithmic scale, the
cell's median and `fence` times the way from its lower quartile to its median, which is at
least a chi-square variable's. Half of a cell may be junk before that moves; 3.5 is the way to
the 0.9996 quantile of a chi-square variable. Statistics are those of the text and
`TYPICAL_WORDS` average words of its language, so that of a few words less is made.

Defined cases: a null text has no words (all counts 0, base_failed); null languages and
sources are cells of their own; ties in distance stand on one side of the support together;
columns of docs named like an added one are kept as own_<name>; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, is_small, map_batches, materialize, pieces, small, text_bytes, with_own_names, word_hashes, word_spans

SUPPORT, MOST_STEPS, TOLERANCE, PRIOR, FENCE, TYPICAL_WORDS, WINDOW = 0.75, 12, 1e-2, 100.0, 3.5, 100, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_punct", "n_digits")
FEATURES = ("log_words", "word_length", "symbols", "upper", "punct", "repeats")
#: Lower quartile and median of a chi-square variable of as many degrees of freedom as there are features.
CHI_SQUARE = (3.4546, 5.3481)
#: The least standard deviation of each feature, for cells in which it hardly varies.
FLOOR = (0.2, 0.05, 0.03, 0.03, 0.03, 0.1)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _UPPER, _PUNCT, _DIGIT = _mask("#*$%&|<>"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("!?.,;:\"'()[]{}/\\-_=+@^~`"), _mask("0123456789")


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text (words first[i]..first[i+1]) its words in windows found twice or more in it."""
    n = len(hashes)
    if n < window:
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mixed = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - window + 1 + j]
    start = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key = mixed[start] * np.uint64(0xD6E8FEB86659FD93) + doc[start].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    again = start[order[same[1:] | same[:-1]]]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return np.diff(total[first])


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(" \t\n\x0b\x0c\r"))
        else:
            seen.add(line)
    return n


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of an Arrow string column."""
    data, offsets = text_bytes(column)
    start, end, first = word_spans(data, offsets)
    running = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    ink = np.ones(256, bool)
    ink[[0x20, 9, 10, 11, 12, 13]] = False
    ink[0x80:0xC0] = False
    return {
        "n_words": np.diff(first),
        "word_chars": running(ink[data]),
        "n_symbols": running(_SYMBOL[data]),
        "n_dup_lines": np.array([duplicate_lines(t) if t else 0 for t in column.to_pylist()], np.int64),
        "n_repeat_words": repeated_words(word_hashes(data, start, end, lower=False), first),
        "n_upper": running(_UPPER[data]),
        "n_punct": running(_PUNCT[data]),
        "n_digits": running(_DIGIT[data]),
    }


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with the counts of their whole texts added; nothing is shuffled."""
    docs = with_own_names(docs, (*COUNTS, *MORE))
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                counts = text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(counts[c], pa.int64()) for c in (*COUNTS, *MORE))], names=[*names, *COUNTS, *MORE])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE))]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rates(counts: DataFrame) -> DataFrame:
    """For each language what a text of it has on average: characters a word, and shares of symbols, capitals, marks and repeats."""
    n, chars = F.greatest(F.sum("n_words"), F.lit(1)), F.greatest(F.sum("word_chars"), F.lit(1))
    return counts.groupBy(_cell()[0]).agg((chars / n).alias("r_length"), *((F.sum(f"n_{c}") / chars).alias(f"r_{c}") for c in ("symbols", "upper", "punct")), (F.sum("n_repeat_words") / n).alias("r_repeats"))


def features() -> list[Column]:
    """Statistics of a text with counts and its language's rates: each as if TYPICAL_WORDS average words were added, since few words vary much."""
    words = F.col("n_words") + float(TYPICAL_WORDS)
    more = TYPICAL_WORDS * F.col("r_length")
    chars = F.col("word_chars") + more
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / words),
        *(F.sqrt((F.col(f"n_{c}") + more * F.col(f"r_{c}")) / chars) for c in ("symbols", "upper", "punct")),
        F.sqrt((F.col("n_repeat_words") + TYPICAL_WORDS * F.col("r_repeats")) / words),
    ]


D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
MOMENTS = ["n", *(f"s{i}" for i in range(D)), *(f"q{i}_{j}" for i, j in PAIRS)]
CELL, STARTS = ["cell_lang", "cell_source"], 3
#: Levels of a logarithmic scale of distances, a 64th of a factor two each.
_FINE = 64
_LOG_SPREAD = float(np.log2(CHI_SQUARE[1] / CHI_SQUARE[0]))
VERDICT = ("base_failed", "distance", "kept")


def _cell() -> list[Column]:
    """The names of a row's cell; a null language or source has one of its own."""
    return [F.concat(F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"cell_{c}") for c in ("lang", "source")]


def _plain_moments(rows: DataFrame) -> dict[str, float]:
    """Moments of one row of independent features with the medians and quartile spreads of all rows."""
    r = rows.agg(*(F.percentile_approx(f"f{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"c{i}") for i in range(D))).first()
    q = [r[f"c{i}"] or (0.0, 0.0, 0.0) for i in range(D)]
    m, v = [x[1] for x in q], [max((x[2] - x[0]) / 1.349, floor) ** 2 for x, floor in zip(q, FLOOR)]
    return {"n": 1.0, **{f"s{i}": m[i] for i in range(D)}, **{f"q{i}_{j}": m[i] * m[j] + (v[i] if i == j else 0.0) for i, j in PAIRS}}


def _with_parents(sums: DataFrame, prior: float, plain: dict[str, float]) -> DataFrame:
    """Each cell's moments (for each start) with those of its language as prior more rows, these with those of all, and these with plain ones."""
    whole = lambda keys, name: sums.groupBy("start", *keys).agg(*(F.sum(m).alias(f"{name}_{m}") for m in MOMENTS))
    both = sums.join(whole(["cell_lang"], "lang"), ["start", "cell_lang"]).join(whole([], "all"), "start")
    every = lambda m: (F.col(f"all_{m}") + prior * plain[m]) / (F.col("all_n") + prior)
    mixed = [(F.col(m) + prior * (F.col(f"lang_{m}") + prior * every(m)) / (F.col("lang_n") + prior)).alias(m) for m in MOMENTS]
    return both.select(*CELL, "start", *mixed)


def _inverse(frame: pd.DataFrame) -> pd.DataFrame:
    """From sums and sums of products to means, the inverse of the scatter (a floor under each variance) and its log determinant."""
    out = []
    for r in frame.to_dict("records"):
        n = max(1.0, r["n"])
        mean = np.array([r[f"s{i}"] for i in range(D)]) / n
        cov = np.zeros((D, D))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / n - mean[i] * mean[j]
        cov += np.diag(np.maximum(0, np.array(FLOOR) ** 2 - np.diag(cov)) + 1e-9)
        inv = np.linalg.pinv(cov, hermitian=True)
        out.append([*(r[c] for c in CELL), r["start"], float(np.linalg.slogdet(cov)[1]), *mean, *(inv[p] for p in PAIRS)])
    return pd.DataFrame(out, columns=[*CELL, "start", "log_det", *(f"m{i}" for i in range(D)), *(f"p{i}_{j}" for i, j in PAIRS)])


ESTIMATE = ", ".join([*(f"{c} string" for c in CELL), "start int", "log_det double", *(f"m{i} double" for i in range(D)), *(f"p{i}_{j} double" for i, j in PAIRS)])


def distance() -> Column:
    """The squared Mahalanobis distance of f0.. from m0.. by p0_0.."""
    z = [F.col(f"f{i}") - F.col(f"m{i}") for i in range(D)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + (1.0 if i == j else 2.0) * z[i] * z[j] * F.col(f"p{i}_{j}")
    return F.greatest(out, F.lit(0.0))


def _level(d2: Column) -> Column:
    return F.floor(_FINE * F.log2(d2 + 1e-6)).cast("int")


def _quantile_levels(levels: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Per cell, for each name, the least level that at least the share of the rows is on or under; levels are combined rows."""
    own = Window.partitionBy(*keys)
    running = levels.withColumn("_to", F.sum("n").over(own.orderBy("level"))).withColumn("_all", F.sum("n").over(own))
    return running.groupBy(*keys).agg(*(F.min(F.when(F.col("_to") >= share * F.col("_all"), F.col("level"))).alias(name) for name, share in shares.items()))


def _moments(rows: DataFrame, values: list[Column] | None = None) -> list[Column]:
    f = values or [F.col(f"f{i}") for i in range(D)]
    return [F.count("*").cast("double").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(f)), *(F.sum(f[i] * f[j]).alias(f"q{i}_{j}") for i, j in PAIRS)]


def _first_estimates(rows: DataFrame) -> DataFrame:
    """The starts of each cell: medians, with spreads alone and with correlations of spatial signs and of bounded scores."""
    thirds = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    middle = materialize(rows.groupBy(*CELL).agg(*(F.percentile_approx(f"f{i}", thirds).alias(f"c{i}") for i in range(D))), "quality-middle")
    spread = [F.greatest((F.col(f"c{i}")[2] - F.col(f"c{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(D)]
    z = [(F.col(f"f{i}") - F.col(f"c{i}")[1]) / spread[i] for i in range(D)]
    size = F.sqrt(sum((x * x for x in z), F.lit(1e-12)))
    at = rows.join(small(middle), CELL)
    signs, scores = (at.groupBy(*CELL).agg(*_moments(at, values)) for values in ([x / size for x in z], [F.tanh(x) for x in z]))

    def of(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                cov = np.eye(D)
                if r["n"]:
                    raw = np.zeros((D, D))
                    for i, j in PAIRS:
                        raw[i, j] = raw[j, i] = r[f"q{i}_{j}"] / r["n"]
                    scale = np.sqrt(np.diag(raw) + 1e-12)
                    cov = 0.9 * raw / np.outer(scale, scale) + 0.1 * np.eye(D)  # correlations, away from singular ones
                wide = np.array([max((r[f"c{i}"][2] - r[f"c{i}"][0]) / 1.349, FLOOR[i]) for i in range(D)])
                inv = np.linalg.inv(cov * np.outer(wide, wide))
                out.append([*(r[c] for c in CELL), r["start"], 1e300, *(r[f"c{i}"][1] for i in range(D)), *(inv[p] for p in PAIRS)])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ESTIMATE.split(", ")])

    none = [F.lit(0.0).alias(m) for m in MOMENTS]
    tables = [middle.select(*CELL, F.lit(0).alias("start"), *none, *(f"c{i}" for i in range(D)))]
    tables += [s.join(middle, CELL).select(*CELL, F.lit(k).alias("start"), *MOMENTS, *(f"c{i}" for i in range(D))) for k, s in ((1, signs), (2, scores))]
    return materialize(tables[0].union(tables[1]).union(tables[2]).mapInPandas(of, ESTIMATE), "quality-start")


def fit_cells(counts: DataFrame, support: float = SUPPORT, most_steps: int = MOST_STEPS, tolerance: float = TOLERANCE, prior: float = PRIOR, fence: float = FENCE) -> DataFrame:
    """The estimate of each cell with the median and the fence of its distances (levels); counts: lang, source, counts of all documents."""
    means = materialize(rates(counts), "quality-rates")
    rows = counts.select("*", *_cell()).join(small(means), "cell_lang").select(*CELL, *(f.alias(f"f{i}") for i, f in enumerate(features())))
    rows = materialize(rows, "quality-features")
    now, keys, plain = _first_estimates(rows), [*CELL, "start"], _plain_moments(rows)
    near = F.broadcast if is_small(now) else lambda df: df  # estimates and levels of cells are as many in each step
    last = float("inf")
    for _ in range(most_steps):
        at = rows.join(near(now), CELL).select(*keys, *(f"f{i}" for i in range(D)), _level(distance()).alias("level"))
        most = _quantile_levels(at.groupBy(*keys, "level").agg(F.count("*").alias("n")), keys, {"most": support})
        inner = at.join(near(most), keys).where(F.col("level") <= F.col("most"))
        sums = materialize(inner.groupBy(*keys).agg(*_moments(inner)), "quality-sums")
        now = materialize(_with_parents(sums, prior, plain).mapInPandas(lambda frames: map(_inverse, frames), ESTIMATE), "quality-step")
        volume = now.agg(F.avg("log_det")).first()[0]
        if volume is None or volume > last - tolerance:  # on average no determinant falls any more
            break
        last = volume
    names = [c for c in now.columns if c != "start"]
    best = now.groupBy(*CELL).agg(F.min_by(F.struct(*names[2:]), F.struct("log_det", "start")).alias("best")).select(*CELL, "best.*")
    best = materialize(best, "quality-best")
    levels = rows.join(small(best), CELL).groupBy(*CELL, _level(distance()).alias("level")).agg(F.count("*").alias("n"))
    quartiles = _quantile_levels(levels, CELL, {"low_level": 0.25, "median_level": 0.5})
    spread = F.greatest((F.col("median_level") - F.col("low_level")) / _FINE, F.lit(_LOG_SPREAD))
    bound = quartiles.select(*CELL, "median_level", (F.col("median_level") / _FINE + fence * spread).alias("fence"))
    return materialize(best.join(bound, CELL).join(means, "cell_lang"), "quality-cells-fit")


def judge(counted: DataFrame, estimates: DataFrame) -> DataFrame:
    """counted (documents with counts) with base_failed, distance (chi-square scale) and kept; rows stay where they are."""
    counted = with_own_names(counted, VERDICT)
    # the documents' own columns travel in a struct, so that no name of theirs meets one used here
    rows = counted.select(F.struct(*counted.columns).alias("row"), base_failed().alias("base_failed"), *_cell(), *COUNTS, *MORE)
    rows = rows.join(small(estimates), CELL, "left").withColumns({f"f{i}": f for i, f in enumerate(features())}).withColumn("_d", distance())
    scale = F.pow(F.lit(2.0), F.col("median_level") / _FINE) / CHI_SQUARE[1]
    inside = F.coalesce(F.log2(F.col("_d") + 1e-6) <= F.col("fence"), F.lit(True))
    return rows.select("row.*", "base_failed", (F.col("_d") / F.greatest(scale, F.lit(1e-6))).alias("distance"), (~F.col("base_failed") & inside).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"), "lang", "source")
    counts = materialize(with_counts(docs).drop("text"), "quality-counts")
    return judge(counts, fit_cells(counts)).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
