"""BPE as a deterministic automaton over tokens.

Construction: begin with one state that every base symbol leaves and enters. Then for each
merge (u, v) -> w, in order, apply a merge gadget to the state s that u leads to: a copy s'
of s without the arc v becomes u's target, and each state with an arc u gets an arc w to
where v led. In the end the automaton accepts, for each string, exactly its BPE tokens.

All arcs of a token lead to one state, so a state is stored as (parent, born, removed): what
it was copied from, by which merge, and which arc it lost. Arcs gained later follow from the
merges: a state that was there when w was made has the arc w if it has the arc u. Looked-up
transitions are kept in a table.

Encoding runs a word through the automaton: every prefix of it has one token sequence, so
from each reached position the tokens that start there (by a trie) are tried as arcs.
Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import ODD, byte_letters, default_path
from .common import documents, map_batches, pieces


class IntTable:
    """A hash table from non-negative 64-bit keys to integers that looks up whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray, default: int = -1) -> np.ndarray:
        slot = self._slot(key)
        out = self.values[slot]
        there = self.keys[slot]
        out[there < 0] = default
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            out[left] = np.where(there < 0, default, self.values[slot[left]])
            left = left[(there != key[left]) & (there >= 0)]
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Adds keys that differ from one another and from those there."""
        if 2 * (self.used + len(key)) > len(self.keys):
            full = self.keys >= 0
            old = self.keys[full], self.values[full]
            self.__init__(max(self.bits + 1, int(4 * (self.used + len(key))).bit_length()))
            self.put(*old)
        self.used += len(key)
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = key[free]  # of several for one slot, the last stays
            self.values[slot[free]] = value[free]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.label = {i: t for t, i in vocab.items()}
        made = {}
        for k, (a, b) in enumerate(merges):
            made.setdefault(vocab[a + b], (k, vocab[a], vocab[b]))
        self.made = made
        self.target = dict.fromkeys(self.label, 0)
        self.parent, self.born, self.removed = [0], [-1], [-1]
        self.dead: set[int] = set()
        self.table = IntTable()
        self.lost: dict[int, dict[int, int]] = {}
        for w, (k, u, v) in sorted(made.items(), key=lambda x: x[1][0]):
            s = self.target[u]
            if not self._has(s, v):
                self.dead.add(w)
                continue
            self.target[w] = self.target[v]
            self.parent.append(s)
            self.born.append(k)
            self.removed.append(v)
            self.target[u] = len(self.parent) - 1
            if u == v:  # the copied arc u of the old state now leads to the copy; w leads to where v led before
                self.target[w] = s
        letters = byte_letters()
        trie: dict[int, int] = {}
        accept = [-1]
        symbol = {c: i for i, c in enumerate(letters)}
        for token, i in vocab.items():
            last = token.endswith(suffix) and bool(suffix)
            body = token[: len(token) - len(suffix)] if last else token
            if i in self.dead or not body or any(c not in symbol for c in body):
                continue
            node, codes = 0, [symbol[c] for c in body]
            if last:
                codes[-1] += 256
            for c in codes:
                node = trie.setdefault(node << 9 | c, len(accept))
                if node == len(accept):
                    accept.append(-1)
            accept[node] = i
        self.trie = IntTable()
        self.trie.put(np.fromiter(trie, np.int64, len(trie)), np.fromiter(trie.values(), np.int64, len(trie)))
        self.accept = np.array(accept)
        self.target = np.array([self.target.get(i, 0) for i in range(max(self.label) + 1)])
        self.ends = 256 if suffix else 0

    def _has(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        born, removed, parent, made = self.born, self.removed, self.parent, self.made
        while state:
            k, u = made[token][:2] if token in made else (-1, -1)
            if born[state] > k:
                if removed[state] == token:
                    return False
                state = parent[state]
            else:
                token = u
        return True

    def has(self, state: int, token: int) -> bool:
        """The same, with the arcs lost on the way from the first state to this one in a table."""
        lost = self.lost.get(state)
        if lost is None:
            lost, q = {}, state
            while q:
                lost[self.removed[q]] = self.born[q]
                q = self.parent[q]
            self.lost[state] = lost
        before = len(self.born)
        while token in self.made:
            k, u, _ = self.made[token]
            if k < lost.get(token, -1) <= before:
                return False
            before, token = k, u
        return not -1 < lost.get(token, -1) <= before

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Where each state's arc for a token leads, -1 without such an arc."""
        key = state.astype(np.int64) << 20 | token
        to = self.table.get(key, -2)
        new = np.unique(key[to == -2])
        if len(new):
            self.table.put(new, np.array([self.target[k & 0xFFFFF] if self.has(k >> 20, k & 0xFFFFF) else -1 for k in new.tolist()]))
            to = self.table.get(key, -2)
        return to

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of pre-split words; words of about one length advance together."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(-len(w) // 6 * -6 if len(w) < 32 else 1 << len(w).bit_length(), []).append(i)
        for most, members in by_size.items():
            step = max(1, (1 << 20) // max(1, most))
            for at in range(0, len(members) if most else 0, step):
                own = members[at : at + step]
                for i, ids in zip(own, self._together([words[i] for i in own])):
                    out[i] = ids
        return out

    def _together(self, words: list[bytes]) -> list[list[int]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        most, n = int(size.max()), len(words)
        codes = np.zeros((n, most), np.int64)
        codes[np.arange(most) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        codes[np.arange(n), size - 1] += self.ends
        state = np.full((n, most + 1), -1, np.int32)
        came, token = np.zeros((n, most + 1), np.int32), np.zeros((n, most + 1), np.int32)
        state[:, 0] = 0
        for i in range(most):
            row = np.flatnonzero((state[:, i] >= 0) & (size > i))
            node = np.zeros(len(row), np.int64)
            for j in range(i, most):
                node = self.trie.get(node << 9 | codes[row, j])
                live = node >= 0
                row, node = row[live], node[live].astype(np.int64)
                if not len(row):
                    break
                t = self.accept[node]
                at = np.flatnonzero((t >= 0) & (state[row, j + 1] < 0))
                to = self.arcs(state[row[at], i], t[at])
                ok = to >= 0
                at = at[ok]
                state[row[at], j + 1], came[row[at], j + 1], token[row[at], j + 1] = to[ok], i, t[at]
                live = size[row] > j + 1
                row, node = row[live], node[live]
                if not len(row):
                    break
        back, at = [], size.copy()
        every = np.arange(n)
        while at.any():
            back.append(np.where(at > 0, token[every, at], -1))
            at = np.where(at > 0, came[every, at], 0)
        return [[t for t in r if t >= 0] for r in np.array(back[::-1]).T.tolist()]


class WordBpe:
    """A lower-casing word-level BPE file as an encoder and decoder of whole texts."""

    def __init__(self, path: str, most: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.labels = self.automaton.label | {i: t for t, i in self.special.items()}
        self.most = most
        self.words: dict[str, list[int]] = {}
        self.cache: dict[str | tuple[str], tuple[str, str]] = {}

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letters are lowered one by one
        text = text.lower()
        return [c for c in self.pattern.findall(text)] if ODD.search(text) else text.split()

    def chunks(self, text: str) -> list[str | tuple[str]]:
        """Parts of a text that can be encoded apart: words with what clings to them, and special tokens, each in a tuple."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._plain(text[at : m.start()]), (m[0],)]
            at = m.end()
        return out + self._plain(text[at:])

    def _ids(self, chunks: list[str | tuple[str]]) -> list[list[int]]:
        """The ids of each chunk; words not seen before run through the automaton together."""
        split = [() if isinstance(c, tuple) else self.pattern.findall(c) for c in chunks]
        new = list({w for ws in split for w in ws if w not in self.words})
        self.words.update(zip(new, self.automaton.encode([w.encode() for w in new])))
        return [[self.special[c[0]]] if isinstance(c, tuple) else [i for w in ws for i in self.words[w]] for c, ws in zip(chunks, split)]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one blank between two (the file names no decoder)."""
        return " ".join([self.labels[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for ids in self._ids(self.chunks(text)) for i in ids]

    def written(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text the ids in decimal, and the decoded text, both joined by blanks."""
        split = [self.chunks(t) for t in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
            self.words.clear()
        new = list({c for cs in split for c in cs if c not in self.cache})
        self.cache.update((c, (" ".join(map(str, ids)), self.decode(ids))) for c, ids in zip(new, self._ids(new)))
        get = self.cache.__getitem__
        out = []
        for cs in split:
            got = [x for x in map(get, cs) if x[0]]
            out.append((" ".join([x[0] for x in got]), " ".join([x[1] for x in got])))
        return out


_open: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _open:
        _open[path] = WordBpe(path)
    return _open[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens and digests of its ids and of the text they decode to.

    A null text counts as empty: no tokens, digests of the empty string. Repeated rows give
    repeated results; other columns of docs are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        own = word_bpe(path)
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                written = own.written([t or "" for t in part.column("text").to_pylist()])
                rows = [(ids.count(" ") + 1 if ids else 0, digest(ids), digest(decoded)) for ids, decoded in written]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)
        own.cache.clear()
        own.words.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), default_path("word_bpe_49k.json"))
