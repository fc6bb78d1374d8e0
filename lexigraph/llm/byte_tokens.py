"""Ids of whole texts by a public byte-level BPE file, with each distinct chunk encoded once.

The tokenizer's own pattern never joins across white space but for one leading blank, so a
text falls into chunks (a word with what clings to it and its blank, or a run of white
space) that can be encoded apart. A bounded cache holds the ids of chunks; what it has not
seen is encoded together: in one string, by the same merges as ranks, if it is a word after a
blank, else by the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import repeat

import numpy as np

CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python but not to the tokenizer's pattern.
ODD = re.compile("[\x1c-\x1f]")
#: The pattern that byte-level BPE files of this kind split by (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_open: dict[str, "ChunkCoder"] = {}


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


def _ranked(path: str):
    """A rank encoder of the same ids, where ids follow the order of the merges; and which ids begin with a blank."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        return None, None
    back = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    begins = np.zeros(len(model["vocab"]), bool)
    begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), begins


class ChunkCoder:
    def __init__(self, path: str, most: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked, self.begins = _ranked(path)
        self.most = most
        self._clear()

    def forget(self) -> None:
        """Gives up what is cached, at the end of a task: the worker goes on to others."""
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _room(self, name: str, n: int) -> None:
        own = getattr(self, name)
        if n > len(own):
            setattr(self, name, np.concatenate([own, np.zeros(max(n, 2 * len(own)) - len(own), own.dtype)]))

    def _after_blank(self, chunk: str) -> bool:
        """Whether the chunk is one blank and a word, so that its tokens can be told apart in a row of such."""
        return len(chunk) > 1 and chunk[0] == " " and not chunk[1].isspace() and chunk.find(" ", 1) < 0 and not self._whole(chunk)

    def _add(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if self._after_blank(c)] if self.ranked else []
        if plain:
            ids = np.array(self.ranked.encode_ordinary("".join(plain)), np.int32)
            self._keep(plain, ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids))))
        other = [c for c in chunks if c not in self.index]
        if other:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(other, np.fromiter((i for ids in got for i in ids), np.int32, int(sizes.sum())), sizes)

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.index)
        self._room("flat", self.used + len(ids))
        self._room("start", n + len(chunks))
        self._room("size", n + len(chunks))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(chunks)] = sizes
        self.used += len(ids)
        self.index.update(zip(chunks, range(n, n + len(chunks))))

    def _whole(self, text: str) -> bool:
        return bool(ODD.search(text)) or any(s in text for s in self.special)

    def chunks(self, text: str) -> list[str]:
        if self._whole(text):
            return [text]
        return CHUNK.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(chunks)
            chunks += self.chunks(text)
            counts[i] = len(chunks) - before
        if len(self.index) > self.most:
            self._clear()
        which = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            self._add(list(dict.fromkeys(chunks[i] for i in missing)))
            which[missing] = [self.index[chunks[i]] for i in missing]
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[which] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


def coder(path: str) -> ChunkCoder:
    """One coder for each file and Python worker."""
    if path not in _open:
        _open[path] = ChunkCoder(path)
    return _open[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
