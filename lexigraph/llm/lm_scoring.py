"""Language-model scoring: a causal self-attention model in numpy over subword ids.

Texts are encoded once: each distinct word (A-Z lower-cased, as it stands after a blank) has
its ids by a public byte-level BPE file, and a text is the ids of its words and an end id.
White space itself is not modelled, as in the base score.

Base: add-one log10 probability of a text's words. Word counts are summed over all training
documents. The most frequent words (a bounded table) are looked up where the texts are; the
rare rest meets the table of counts in a join.

Model: one causal self-attention layer and a feed-forward layer. Inputs are the commonest ids
and shared symbols for the others. Outputs are cells in two levels, a group and a member of
it: the commonest ids have a cell each, ids of like spelling in one group; the others share
the last group's cells, in which an id has its share of the cell's count. Ids and cells come
from counts over all training documents. Training is Adam in each partition, then a weighted
mean of the partitions' parameters (a sum in integers, so that it does not vary), in rounds.
Every block of every training text is trained on once: round r of `rounds` has its own share of
them, by a hash of row and run of blocks. Runs of ids are what is shuffled; windows are made of them where they are
trained on, and a task sends one sum of its partitions' parameters.

Scoring: a text's ids lie in blocks of half a context; each block is scored once, with the
block before it as context (the first has masked padding), so windows overlap by half and
every id has at least half a context, where the text has it. Windows of many texts form a
batch; the mask lets a position see itself, what is before it, and no padding.

Memory: a text's ids are cut into segments where a hash of two ids says so, about `SEGMENT`
ids each. c(s | t) is the number of training texts in which s follows the first t; a segment
that follows the first t of its text has the probability (c(s | t) + p) / (sum of c(. | t) + 1),
p being the model's. What it adds to the model's score is a column of its own, `recalled`; the score is the
attention model's alone. What is counted follows the corpus. A text of the training part is left out of the
counts that recall it, so `recalled` tells what the rest of the corpus knows of it.

Defined cases: a null text counts as empty and has the end token alone; a null doc_id is in
the training part; without any training document all counts are 0 and the model is as
initialised; rows that repeat doc_id and text get equal scores, but for rounding, and count each; other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import IntTable
from .byte_tokens import byte_letters, coder, default_path
from .common import _LOWER, documents, held_out_fold, join_counted, map_batches, materialize, mix64, pieces, text_bytes, whole_text, word_hashes, word_spans

END_WORD = np.int64(1)  # stands for the end token among word hashes
TOP_WORDS = 200_000
INPUTS, SHARED, WIDTH, HIDDEN, GROUPS, MEMBERS, BLOCK = 1024, 128, 32, 64, 32, 32, 16
PAD, CELLS = INPUTS + SHARED, GROUPS * MEMBERS
ROUNDS, BATCH, RATE, PART_WINDOWS = 2, 64, 6e-3, 16384
#: Blocks of a run of ids, and partitions that one task trains one after the other.
RUN, TASK_PARTS = 16, 8
SEGMENT = 64
_SPACE, _ODD = re.compile(r"[\s\x1c-\x1f]"), re.compile(r"[^\S ]|[\x1c-\x1f]")
_ID = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 1 << 17, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- ids and words ------------------------------------------------------------------------


def id_hashes(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each run of ids (runs begin at start and end where the next begins)."""
    if not len(start):
        return np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(ids)))
    place = np.arange(len(ids)) - np.repeat(start, size)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max()), _STEP, np.uint64)))
    return mix64(np.add.reduceat(_ID[ids] * power[place], start) + size.astype(np.uint64)).view(np.int64)


class WordIds:
    """The ids of words as they stand after a blank; a table by hashes of words holds those seen."""

    def __init__(self, path: str, most: int = 1_500_000):
        self.coder = coder(path)
        vocab = self.coder.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.end_id = self.size - 1
        self.kind = np.dtype("<u2" if self.size < 0xFFFF else "<u4")
        names = sorted(vocab, key=lambda t: (t, vocab[t]))
        self.alike = np.zeros(self.size, np.int64)  # the place of each id among all, by spelling
        self.alike[[vocab[t] for t in names]] = np.arange(len(names))
        blank = byte_letters()[32]
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(blank)]] = True
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = IntTable(14), 0, 0
        self.flat, self.start, self.length, self.key = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of n words, each with a blank before it, and how many each has."""
        ranked = self.coder.ranked
        if ranked is not None and not _ODD.search(text):
            ids = np.array(ranked.encode_ordinary(text), np.int64)
            return ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
        got = self._encode_each(text[1:].split(" "))
        return np.concatenate(got), np.fromiter(map(len, got), np.int64, n)

    def _encode_each(self, words: list[str]) -> list[list[int]]:
        ranked = self.coder.ranked
        if ranked is None:
            return [e.ids for e in self.coder.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii() or not _SPACE.search(w)]
        plain = [i for i in plain if not _SPACE.search(words[i])]
        ids = np.array(ranked.encode_ordinary(" " + " ".join([words[i] for i in plain])) if plain else [], np.int64)
        cut = np.append(np.flatnonzero(self.begins[ids]), len(ids)).tolist()
        for i, a, b in zip(plain, cut, cut[1:]):
            out[i] = ids[a:b]
        return [ranked.encode_ordinary(" " + w) if o is None else o for w, o in zip(words, out)]

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word in the table, new ones added."""
        hashes = (word_hashes(data, start, end) >> np.uint64(1)).view(np.int64)
        found = self.table.get(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            length = end[at] - start[at] + 1  # with the blank
            stops = np.cumsum(length)
            own = np.repeat(start[at] - 1 - (stops - length), length)
            own += np.arange(stops[-1])
            letters = _LOWER[data[own]]
            letters[stops - length] = 32
            ids, size = self._encode(letters.tobytes().decode(), len(at))
            ids = ids.astype(self.kind)
            begin = np.cumsum(size) - size
            for name, values in (("flat", ids), ("start", begin + self.used), ("length", size), ("key", id_hashes(ids, begin))):
                own, at = getattr(self, name), self.used if name == "flat" else self.n
                if at + len(values) > len(own):
                    own = np.concatenate([own, np.zeros(max(len(values), len(own)), own.dtype)])
                    setattr(self, name, own)
                own[at : at + len(values)] = values
            self.table.put(new, np.arange(self.n, self.n + len(new)))
            self.n, self.used = self.n + len(new), self.used + len(ids)
            found[missing] = self.table.get(hashes[missing])
        return found

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these words one after the other, and how many each has."""
        size = self.length[entries]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[entries] - (ends - size), size) + np.arange(int(size.sum()))], size


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table for each file and Python worker."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]


ENCODED = "doc_id long, row_key long, held_out boolean, n_words long, ids binary, word long, id long, c long"


def encode_texts(docs: DataFrame, path: str, modulus: int = 7, fold: int = 2) -> DataFrame:
    """A row with the ids of each text, and by task rows with counts of training words (word, c) and ids (id, c)."""
    names = [c.split()[0] for c in ENCODED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

    def run(batches):
        own = word_ids(path)
        own.clear()
        counts, texts = np.zeros(0, np.int64), 0

        def counted():
            seen = np.flatnonzero(counts)
            ids, size = own.ids_of(seen)
            by_id = np.bincount(ids, np.repeat(counts[seen], size), own.size).astype(np.int64)
            by_id[own.end_id] += texts
            used = np.flatnonzero(by_id)
            yield batch_of(len(seen) + 1, word=pa.array(np.append(own.key[seen], END_WORD)), c=pa.array(np.append(counts[seen], texts)))
            yield batch_of(len(used), id=pa.array(used), c=pa.array(by_id[used]))

        for batch in batches:
            for part in pieces(batch, "text"):
                if own.n > own.most:
                    yield from counted()
                    own.clear()
                    counts, texts = np.zeros(0, np.int64), 0
                data, offsets = text_bytes(part.column("text"))
                start, end, first = word_spans(data, offsets)
                entries = own.entries(data, start, end)
                ids, size = own.ids_of(entries)
                bounds = np.append(0, np.cumsum(size))[first] * own.kind.itemsize
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                more = np.bincount(entries[np.repeat(train, np.diff(first))], minlength=own.n)
                more[: len(counts)] += counts
                counts, texts = more, texts + int(train.sum())
                binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield batch_of(part.num_rows, doc_id=part.column("doc_id"), row_key=part.column("row_key"), held_out=part.column("held_out"), n_words=pa.array(np.diff(first)), ids=binary)
        if texts:
            yield from counted()
        own.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", whole_text()).alias("row_key"), held_out_fold(modulus, fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, ENCODED)


def top_words(counts: DataFrame, most: int = TOP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The words above the least count that at most `most` words reach, and their counts: a bounded table."""
    steps = counts.groupBy(F.floor(16 * F.log2("c")).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.col("c") >= least).toPandas().sort_values("word")
    return rows["word"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)


# --- the model ----------------------------------------------------------------------------


class Vocabulary:
    """Maps ids to input symbols, output cells and log shares in the cell, by counts over the corpus."""

    def __init__(self, counts: np.ndarray, end_id: int, alike: np.ndarray | None = None):
        n, head = len(counts), CELLS - MEMBERS
        order = np.lexsort((np.arange(n), -counts))
        self.end_id = end_id
        self.symbol = (INPUTS + np.arange(n) % SHARED).astype(np.int32)
        self.symbol[order[:INPUTS]] = np.arange(min(INPUTS, n))
        own = order[:head]
        own = own[np.argsort(own if alike is None else alike[own], kind="stable")]
        self.cell = np.zeros(n, np.int32)
        self.cell[own] = np.arange(len(own))
        rest = order[head:]
        mass = np.cumsum(counts[rest] + 0.5)
        self.cell[rest] = head + np.minimum(MEMBERS - 1, (mass / mass[-1] * MEMBERS).astype(np.int64)) if len(rest) else 0
        weight = counts + 0.5
        total = np.bincount(self.cell, weight, CELLS)
        self.share = np.log(weight / total[self.cell]).astype(np.float32)
        smooth = (total + 0.5).reshape(GROUPS, MEMBERS)
        self.group_prior = np.log(smooth.sum(1) / smooth.sum()).astype(np.float32)
        self.member_prior = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


SHAPES = {"embed": (PAD + 1, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "near": (2 * BLOCK,), "up": (WIDTH, HIDDEN), "up_bias": (HIDDEN,), "down": (HIDDEN, WIDTH), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,), "member": (GROUPS, WIDTH, MEMBERS), "member_bias": (GROUPS, MEMBERS)}


SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def initial(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "near": 0.0, "up_bias": 0.0, "group": 0.05, "member": 0.05}
    out = {k: (rng.standard_normal(s) * scale.get(k, 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in SHAPES.items()}
    return out | {"group_bias": vocabulary.group_prior.copy(), "member_bias": vocabulary.member_prior.copy()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def views(x: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters that lie one after the other in x, not copied."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s)
        at += n
    return out


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v.astype(np.float32) for k, v in views(x).items()}


_I, _J = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None, :]
_DISTANCE = np.clip(_I + BLOCK - _J, 0, None)
_FUTURE = np.where(_J > _I + BLOCK, np.float32(-1e9), np.float32(0))
#: Of each input symbol the places of its embedding in a flat array of pairs of numbers.
_PAIRS = np.arange((PAD + 1) * (WIDTH // 2)).reshape(PAD + 1, WIDTH // 2)


def tables(p: dict) -> np.ndarray:
    """The map from an embedding to what it is compared with others' embeddings by: the queries' times the keys'."""
    return p["query"] @ p["key"].T / np.float32(np.sqrt(WIDTH))


def _rows(x: np.ndarray) -> np.ndarray:
    """Rows (a multiple of BLOCK) in runs of 8 blocks or one: of small products numpy makes more in a second than of large and narrow ones."""
    return x.reshape(-1, BLOCK if len(x) % (8 * BLOCK) else 8 * BLOCK, x.shape[-1])


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y for many rows x."""
    return (_rows(x) @ np.ascontiguousarray(y)).reshape(len(x), -1)


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y for many rows x and y."""
    return (_rows(x).transpose(0, 2, 1) @ _rows(y)).sum(0)


def _plain(total: np.ndarray) -> bool:
    """Whether sums of exponentials are neither too large nor too small."""
    return not total.size or bool(total.min() > 1e-30 and total.max() < np.inf)


def _attention(p: dict, s: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """Weights of the keys from scores s, each row's sum 1; the future and padding have none."""
    near = p["near"][_DISTANCE] + _FUTURE
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(s)
        e *= np.exp(near)
        e[padded, :, :BLOCK] = 0
        total = e @ np.ones(2 * BLOCK, np.float32)
    if not _plain(total):
        s = s + near
        s[padded, :, :BLOCK] = -1e9
        s -= s.max(-1, keepdims=True)
        e = np.exp(s)
        total = e.sum(-1)
    e *= (1 / total)[:, :, None]
    return e


def forward(p: dict, own: np.ndarray, x: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """Last hidden states for the last BLOCK positions of windows x of 2 * BLOCK symbols, in that order of rows, and what the gradient needs.

    A window's first block is padding as a whole or not at all; padding at its end is only seen by itself. Keys'
    and values' maps are applied to queries and to sums of what is seen, so not to each place that is seen.
    """
    c = np.take(p["embed"], x, axis=0)
    a = c[:, BLOCK:] @ own
    across = c.transpose(0, 2, 1).copy()
    e = _attention(p, a @ across, x[:, 0] == PAD)
    met = (e @ c).reshape(-1, WIDTH)
    h = _times(met, p["value"])
    h += c[:, BLOCK:].reshape(-1, WIDTH)
    h = h if order is None else np.take(h, order, axis=0)
    u = _times(h, p["up"])
    u += p["up_bias"]
    np.maximum(u, 0, out=u)
    g = _times(u, p["down"])
    g += h
    return g, (a, c, across, e, met, h, u)


def _by_group(cell: np.ndarray) -> tuple:
    """The order of rows by their cell's group, each one's group and member in it, and the groups that are there with their bounds."""
    order = np.argsort((cell // MEMBERS).astype(np.uint8), kind="stable")
    cell = np.take(cell, order).astype(np.int64)
    group, member = cell // MEMBERS, cell % MEMBERS
    ends = np.searchsorted(group, np.arange(1, GROUPS + 1)).tolist()
    return order, group, member, [(k, a, b) for k, a, b in zip(range(GROUPS), [0, *ends], ends) if b > a]


def _levels(p: dict, g: np.ndarray, group: np.ndarray, bounds: list) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all groups, and of the members of each row's own group, of rows in the order of groups."""
    z = np.empty((len(g), MEMBERS), np.float32)
    for k, a, b in bounds:
        np.dot(g[a:b], p["member"][k], out=z[a:b])
    z += np.take(p["member_bias"], group, axis=0)
    first = _times(g, p["group"])
    first += p["group_bias"]
    return first, z


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of rows up to a factor, their sums, and the logarithms of the sums without that factor."""
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ np.ones(z.shape[1], np.float32)
    if _plain(total):
        return e, total, np.log(total)
    top = z.max(1)
    e = np.exp(z - top[:, None])
    total = e.sum(1)
    return e, total, np.log(total) + top


def log_probability(p: dict, g: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The log probability of each row's cell."""
    order, group, member, bounds = _by_group(cell)
    first, z = _levels(p, np.take(g, order, axis=0), group, bounds)
    rows = np.arange(len(g))
    out = np.empty(len(g), np.float32)
    out[order] = first.ravel()[rows * GROUPS + group] - _exponentials(first)[2] + z.ravel()[rows * MEMBERS + member] - _exponentials(z)[2]
    return out


def loss_and_gradient(p: dict, x: np.ndarray, cell: np.ndarray, weight: np.ndarray, d: dict | None = None) -> tuple[float, dict]:
    """Mean cross entropy of cells where weight is 1, and its gradient, written to d if given."""
    d = views(np.empty(SIZE, np.float32)) if d is None else d
    p = {k: v.astype(np.float32, copy=False) for k, v in p.items()}
    w, n, wt = WIDTH, len(x), weight.ravel()
    order, group, member, bounds = _by_group(cell.ravel())
    own = tables(p)
    g, (a, c, across, e, met, h, u) = forward(p, own, x, order)
    share = np.take(wt / np.float32(max(1.0, float(wt.sum()))), order).astype(np.float32)
    first, z = _levels(p, g, group, bounds)
    rows, ones = np.arange(len(g)), np.ones(len(g), np.float32)
    at_group, at_member = rows * GROUPS + group, rows * MEMBERS + member
    (d1, sum_1, log_1), (d2, sum_2, log_2) = _exponentials(first), _exponentials(z)
    loss = float((log_1 - first.ravel()[at_group] + log_2 - z.ravel()[at_member]) @ share)
    d1 *= (share / sum_1)[:, None]
    d2 *= (share / sum_2)[:, None]
    d1.ravel()[at_group] -= share
    d2.ravel()[at_member] -= share
    d["group"][:], d["group_bias"][:] = _sums(g, d1), ones @ d1
    back, more = p["member"].transpose(0, 2, 1).copy(), np.empty_like(g)
    d["member"][:], d["member_bias"][:] = 0, 0
    for k, i, j in bounds:
        np.dot(g[i:j].T, d2[i:j], out=d["member"][k])
        np.dot(ones[i:j], d2[i:j], out=d["member_bias"][k])
        np.dot(d2[i:j], back[k], out=more[i:j])
    more += _times(d1, p["group"].T)
    du = _times(more, p["down"].T)
    du *= u > 0
    d["down"][:], d["up"][:], d["up_bias"][:] = _sums(u, more), _sums(h, du), ones @ du
    more += _times(du, p["up"].T)
    dh = np.empty_like(more)
    dh[order] = more
    d["value"][:] = _sums(met, dh)
    dmet = _times(dh, p["value"].T).reshape(n, BLOCK, w)
    ds = dmet @ across
    ds *= e
    ds -= e * (ds @ np.ones(2 * BLOCK, np.float32))[:, :, None]
    d["near"][:] = np.bincount(_DISTANCE.ravel(), np.ones(n, np.float32) @ ds.reshape(n, -1), 2 * BLOCK)
    da = (ds @ c).reshape(-1, w)
    dc = ds.transpose(0, 2, 1) @ a
    dc += e.transpose(0, 2, 1) @ dmet
    dh += _times(da, own.T)
    dc[:, BLOCK:] += dh.reshape(n, BLOCK, w)
    both = _sums(c[:, BLOCK:].reshape(-1, w), da) / np.float32(np.sqrt(w))  # of the product of the queries' and keys' maps
    d["query"][:], d["key"][:] = both @ p["key"], both.T @ p["query"]
    d["embed"][:] = 0
    np.add.at(d["embed"].reshape(-1).view(np.complex64), np.take(_PAIRS, x, axis=0).ravel(), dc.reshape(-1).view(np.complex64))
    return loss, d


def train(p: dict, x: np.ndarray, cell: np.ndarray, weight: np.ndarray, epochs: int = 1, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> dict:
    """Adam over the windows, in a random order each epoch, its rate falling to a tenth."""
    now, d, m, v, step = flat(p), *(np.zeros(SIZE, np.float32) for _ in range(4))
    own, into = views(now), views(d)
    rng, t, last = np.random.default_rng(seed), 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            loss_and_gradient(own, x[rows], cell[rows], weight[rows], into)
            t += 1
            # m and v are the means of gradients and their squares, over 0.1 and 0.02
            m *= np.float32(0.9)
            m += d
            d *= d
            v *= np.float32(0.98)
            v += d
            unit = np.sqrt(0.02 / (1 - 0.98**t))
            np.sqrt(v, out=step)
            step += np.float32(1e-8 / unit)
            np.divide(m, step, out=step)
            step *= np.float32(rate * (1 - 0.9 * t / last) * 0.1 / (1 - 0.9**t) / unit)
            now -= step
    return shaped(now)


# --- blocks, training, scoring --------------------------------------------------------------


def blocks_of(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ids as inputs (-1: padding), as targets (-1: none), and the first block of each text.

    A text's inputs are the end id and its ids; its targets its ids and the end id. A block of
    padding stands before each text, and is not among those counted as its blocks.
    """
    n = counts + 1
    blocks = -(-n // BLOCK) + 1
    first = np.cumsum(blocks) - blocks
    size = int(blocks.sum()) * BLOCK
    inputs, targets = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    begin = (first + 1) * BLOCK
    place = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
    inputs[begin] = end_id
    inputs[place + 1] = ids
    targets[place] = ids
    targets[begin + counts] = end_id
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), first + 1


def _ids_in(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // kind.itemsize


def packed(ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as bytes, and where each begins and the last one ends: seven bits of the rank a byte, the last byte of an id under 128, so frequent ids have one."""
    r = rank[ids]
    size = np.ones(len(r), np.int64)
    for bits in range(7, int(rank.max(initial=0)).bit_length(), 7):
        size += r >= 1 << bits
    bounds = np.append(0, np.cumsum(size))
    out = np.empty(bounds[-1], np.uint8)
    out[bounds[1:] - 1] = r & 127
    for k in range(1, int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[bounds[own + 1] - 1 - k] = r[own] >> 7 * k & 127 | 128
    return out, bounds


def unpacked(data: bytes, by_rank: np.ndarray) -> np.ndarray:
    """The ids that were packed."""
    data = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(data < 128)
    size, rank = np.diff(last, prepend=-1), data[last].astype(np.int64)
    for k in range(1, int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        rank[own] |= (data[last[own] - k].astype(np.int64) & 127) << 7 * k
    return by_rank[rank]


RUNS = "turn int, key long, head boolean, run binary"


def training_runs(encoded: DataFrame, path: str, rounds: int = ROUNDS, turn: int | None = None, rank: np.ndarray | None = None) -> DataFrame:
    """turn, key, head (a text's first) and the ids of each run of `RUN` blocks: the block before it, but at the head, its inputs and its last target.

    Of one turn if given; the ids packed if their ranks are given.
    """
    names = ["turn", "key", "head", "run"]

    def run(batches):
        own = word_ids(path)
        for batch in batches:
            for part in pieces(batch, "ids"):
                ids, counts = _ids_in(part.column("ids"), own.kind)
                # the end id, a text's ids, the end id
                begin = np.cumsum(counts + 2) - (counts + 2)
                stream = np.full(len(ids) + 2 * len(counts), own.end_id, own.kind)
                stream[np.repeat(begin + 1 - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
                size = -(-(counts + 1) // (RUN * BLOCK))
                number = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                at, end = np.repeat(begin, size), np.repeat(begin + counts + 2, size)
                a = at + np.maximum(0, number * RUN * BLOCK - BLOCK)
                b = np.minimum(at + (number + 1) * RUN * BLOCK + 1, end)
                key = mix64(np.repeat(part.column("row_key").to_numpy().view(np.uint64), size) + number.astype(np.uint64) * _STEP)
                turns = (key % np.uint64(rounds)).astype(np.int32)
                mine = slice(None) if turn is None else turns == turn
                a, b = a[mine], b[mine]
                if rank is not None:
                    stream, bounds = packed(stream, rank)
                    a, b = bounds[a], bounds[b]
                data = [stream[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(turns[mine]), pa.array((key[mine] >> np.uint64(1)).view(np.int64)), pa.array(number[mine] == 0), pa.array(data, pa.binary())], names=names)

    rows = encoded.where("ids is not null and not held_out").select("row_key", "ids")
    return map_batches(rows, run, RUNS)


def blocks_in(size: np.ndarray, head: np.ndarray) -> np.ndarray:
    """How many blocks runs of so many ids have."""
    return -(-(size - 1 - np.where(head, 0, BLOCK)) // BLOCK)


def windows_of(ids: np.ndarray, size: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the windows of all blocks of runs of so many ids (the block before, the own one, its targets; -1: none), and how many each run has."""
    blocks = blocks_in(size, head)
    first = np.cumsum(blocks + 1) - (blocks + 1)  # of each run the block before it, or padding
    inputs, targets = np.full(int((blocks + 1).sum()) * BLOCK, -1, np.int32), np.full(int((blocks + 1).sum()) * BLOCK, -1, np.int32)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat((first + head) * BLOCK, size) + place
    last = np.repeat(size, size) - 1
    inputs[at[place < last]] = ids[place < last]
    targets[at[place > 0] - 1] = ids[place > 0]
    inputs, targets = inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK)
    own = np.repeat(first + 1 - (np.cumsum(blocks) - blocks), blocks) + np.arange(int(blocks.sum()))
    return np.concatenate([inputs[own - 1], inputs[own], targets[own]], 1), blocks


def training_windows(encoded: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """turn, key and the ids of a window (the block before, the own one, its targets; -1: none) for each block of the runs."""
    schema = pa.schema([("turn", pa.int32()), ("key", pa.int64()), ("window", pa.binary())])

    def run(batches):
        kind = word_ids(path).kind
        for batch in batches:
            windows, blocks = windows_of(*_ids_in(batch.column("run"), kind), batch.column("head").to_numpy(zero_copy_only=False))
            columns = [np.repeat(batch.column(c).to_numpy(), blocks) for c in ("turn", "key")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([w.astype("<i4").tobytes() for w in windows], pa.binary())], schema=schema)

    return map_batches(training_runs(encoded, path, rounds), run, "turn int, key long, window binary")


FIXED_POINT, SENT = float(1 << 20), 16


def fit(encoded: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[Vocabulary, dict]:
    """The vocabulary and the parameters, from the training rows of encoded texts."""
    words = word_ids(path)
    counts = np.zeros(words.size, np.int64)
    for r in encoded.where("id is not null").groupBy("id").agg(F.sum("c").alias("n")).collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    vocabulary = Vocabulary(counts, words.end_id, words.alike)
    p = initial(vocabulary)
    by_rank = np.argsort(-counts, kind="stable").astype(np.int32)
    rank = np.empty_like(by_rank)
    rank[by_rank] = np.arange(len(rank))
    blocks = F.ceil((F.octet_length("ids") / words.kind.itemsize + 1) / BLOCK)
    total = encoded.where("ids is not null and not held_out").agg(F.sum(blocks)).first()[0] or 0
    names = [f"x{i}" for i in range(SENT)]
    for turn in range(rounds):
        start = flat(p)

        def run(batches, start=start, turn=turn):
            runs, heads = [], []
            for b in batches:
                runs += b.column("run").to_pylist()
                heads.append(b.column("head").to_numpy(zero_copy_only=False))
            if not runs:
                return
            head = np.concatenate(heads)
            bounds = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
            size = np.add.reduceat(np.frombuffer(b"".join(runs), np.uint8) < 128, np.append(0, bounds[:-1]), dtype=np.int64)
            ends = np.cumsum(blocks_in(size, head))
            parts = max(1, int(ends[-1]) // PART_WINDOWS)
            cuts = np.searchsorted(ends, ends[-1] * np.arange(1, parts) // parts).tolist()
            n, held = 0, 0
            for a, b in zip([0, *cuts], [*cuts, len(runs)]):
                if b > a:
                    raw, _ = windows_of(unpacked(b"".join(runs[a:b]), by_rank), size[a:b], head[a:b])
                    x = np.where(raw[:, : 2 * BLOCK] < 0, PAD, vocabulary.symbol[raw[:, : 2 * BLOCK]])
                    goal = raw[:, 2 * BLOCK :]
                    p = train(shaped(start), x, vocabulary.cell[goal], (goal >= 0).astype(np.float32), seed=turn)
                    n, held = n + len(x), held + np.rint(len(x) * FIXED_POINT * flat(p).astype(np.float64)).astype(np.int64)
            at = np.arange(0, SIZE, SENT)
            sent = np.append(held, np.zeros(-SIZE % SENT, np.int64)).reshape(-1, SENT)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n)), *(pa.array(c) for c in np.ascontiguousarray(sent.T))], names=["at", "weight", *names])

        if total:
            # equal keys lie together and in order, so a lost task trains the same again
            rows = training_runs(encoded, path, rounds, turn, rank).select("key", "head", "run")
            rows = rows.repartition(max(1, int(total) // rounds // (PART_WINDOWS * TASK_PARTS)), "key").sortWithinPartitions("key", "head", "run")
            trained = map_batches(rows, run, ", ".join(f"{c} long" for c in ["at", "weight", *names]))
            mean = trained.groupBy("at").agg(F.sum("weight").alias("weight"), *(F.sum(c).alias(c) for c in names)).toPandas().sort_values("at")  # as many numbers as parameters, or none: all runs may be of other rounds
            if not len(mean):
                continue
            p = shaped((mean[names].to_numpy(np.float64) / mean[["weight"]].to_numpy(np.float64) / FIXED_POINT).ravel()[:SIZE])
    return vocabulary, p


def token_scores(vocabulary: Vocabulary, p: dict, own: np.ndarray, ids: np.ndarray, counts: np.ndarray, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """All targets of the texts (ids and end ids, in order) and the log10 probability of each: every id once, in its own block."""
    inputs, targets, _ = blocks_of(ids, counts, vocabulary.end_id)
    x = np.where(inputs < 0, PAD, vocabulary.symbol[inputs]).astype(np.int32)
    out = np.zeros(targets.shape, np.float32)
    cell = vocabulary.cell[targets]
    at = np.flatnonzero(targets[:, 0] >= 0)  # but for the blocks of padding
    for i in range(0, len(at), step):
        b = at[i : i + step]
        g, _ = forward(p, own, np.concatenate([x[b - 1], x[b]], 1))
        out[b] = log_probability(p, g, cell[b].ravel()).reshape(-1, BLOCK)
    real = targets >= 0
    stream = targets[real]
    return stream, (out[real] + vocabulary.share[stream]) / np.float32(np.log(10))


def segments(stream: np.ndarray, counts: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Where each segment of the streams begins, and the number of its text; counts: ids of each text with its end id."""
    last = np.cumsum(counts) - 1
    cut = np.zeros(len(stream) + 1, bool)
    cut[0] = True
    two = mix64(_ID[stream[1:]] + _ID[stream[:-1]] * _STEP)
    cut[2:] = two % np.uint64(length) == 0
    cut[last + 1] = True
    start = np.flatnonzero(cut[:-1])
    return start, np.searchsorted(last, start)


SCORED = "doc_id long, row_key long, held_out boolean, n_tokens long, n_top long, base_top double, rare array<long>, net double, pairs array<struct<ctx: long, seg: long, net: double>>"


def score_documents(docs: DataFrame, path: str, modulus: int = 7, fold: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """Base and model scores of every document, learnt from those outside the held-out fold."""
    encoded = materialize(encode_texts(docs, path, modulus, fold), "lm-encoded", "zstd")
    counts = materialize(encoded.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "word-counts", "zstd")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, unit = sums["n"], float(np.log10(sums["n"] + sums["v"] + 1))
    top, found = top_words(counts)
    vocabulary, p = fit(encoded, path, rounds)
    pair = pa.struct([("ctx", pa.int64()), ("seg", pa.int64()), ("net", pa.float64())])

    def run(batches):
        own = word_ids(path)
        table, logs = tables(p), np.log10(np.append(found, 0) + 1.0)
        for batch in batches:
            for part in pieces(batch, "ids", 1 << 19):
                ids, size = _ids_in(part.column("ids"), own.kind)
                begin = np.flatnonzero(own.begins[ids])
                n = part.column("n_words").to_numpy()
                keys = np.insert(id_hashes(ids, begin), np.cumsum(n), END_WORD)
                where = np.minimum(np.searchsorted(top, keys), max(0, len(top) - 1))
                known = top[where] == keys if len(top) else np.zeros(len(keys), bool)
                first = np.cumsum(n + 1) - (n + 1)
                base = np.add.reduceat(np.where(known, logs[where], 0), first) - (n + 1) * unit
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(~known, first, dtype=np.int64))), pa.int32()), pa.array(keys[~known]))
                stream, scores = token_scores(vocabulary, p, table, ids, size)
                start, text = segments(stream, size + 1)
                hashes, net = id_hashes(stream, start), np.add.reduceat(scores, start, dtype=np.float64)
                after = np.flatnonzero(text[1:] == text[:-1]) + 1  # those with one before them in the text
                context = np.bitwise_xor(hashes[after - 1], text[after])
                after = after[np.sort(np.unique(context, return_index=True)[1])]  # the first of its context in the text
                bounds = np.searchsorted(text[after], np.arange(part.num_rows + 1))
                pairs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(hashes[after - 1]), pa.array(hashes[after]), pa.array(net[after])], fields=list(pair)))
                total = np.bincount(text, net, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), part.column("held_out"), pa.array(n + 1), pa.array(np.add.reduceat(known, first, dtype=np.int64)), pa.array(base), rare, pa.array(total), pairs], names=["doc_id", "row_key", "held_out", "n_tokens", "n_top", "base_top", "rare", "net", "pairs"])

    rows = encoded.where("ids is not null").select("doc_id", "row_key", "held_out", "n_words", "ids")
    scored = materialize(map_batches(rows, run, SCORED), "lm-scored", "zstd")
    met = scored.select("row_key", F.explode("rare").alias("word")).join(counts, "word").select("row_key", F.log10(F.col("c") + 1.0).alias("more"), F.lit(1).alias("hits"), F.lit(0.0).alias("recalled"), F.lit(0).alias("times"))
    recalled = remembered(scored).select("row_key", F.lit(0.0).alias("more"), F.lit(0).alias("hits"), "recalled", F.lit(0).alias("times"))
    once = scored.select("row_key", F.lit(0.0).alias("more"), F.lit(0).alias("hits"), F.lit(0.0).alias("recalled"), F.lit(1).alias("times"))
    # rows that repeat a document bring the same rows each, so sums are divided by how often it is there
    sums_of = met.union(recalled).union(once).groupBy("row_key").agg(*(F.sum(c).alias(c) for c in ("more", "hits", "recalled", "times")))
    out = scored.drop("rare", "pairs").join(sums_of, "row_key")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.col("hits") / F.col("times")).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.col("more") / F.col("times")).alias("base_score"),
        F.col("net").alias("score"),
        (F.col("recalled") / F.col("times")).alias("recalled"),
    )


def remembered(scored: DataFrame) -> DataFrame:
    """row_key and what the memory adds to the score, for each segment whose context other texts have."""
    pairs = scored.select("row_key", "held_out", F.inline("pairs"))
    seen = materialize(pairs.groupBy("ctx", "seg").agg(F.count_if(~F.col("held_out")).alias("c"), F.count("*").alias("n")), "lm-segments", "zstd")
    contexts = seen.groupBy("ctx").agg(F.sum("c").alias("all_c"), F.sum("n").alias("all_n")).where("all_n > 1 and all_c > 0")
    known = materialize(seen.join(contexts, "ctx").select("ctx", "seg", "n", "c", "all_c"), "lm-known", "zstd")
    met = join_counted(pairs, known, ["ctx", "seg"], "n")
    own = F.when(F.col("held_out"), 0).otherwise(1)
    c, every, p = F.col("c") - own, F.col("all_c") - own, F.pow(F.lit(10.0), F.col("net"))
    gain = F.when(c > 0, F.log10(c + p) - F.col("net")).otherwise(0.0) - F.log10(every + 1.0)
    return met.select("row_key", gain.alias("recalled"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))
