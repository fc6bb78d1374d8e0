"""Media columns: FLAC streams in a binary column.

Encoding writes STREAMINFO (with the MD5 of the samples), a SEEKTABLE and frames of
`block` 8-bit mono samples, each the cheapest of constant, verbatim and fixed linear
predictors of order 0 to `most_order` (up to 4) with Rice-coded residuals. Decoding reads the container, checks
the CRC-8 of frame headers, the CRC-16 of frames and the MD5, decodes Rice residuals
(several partitions, both parameter widths, escapes), fixed and general linear predictors,
and the samples are written as blocks of PCM bytes with their first sample's offset, so that
`read_samples` reads a range of samples from the blocks that hold it.

Frames of many streams are decoded together: at step i every frame yields its i-th residual
by array operations on a range of lanes, so the interpreter's cost is that of one frame of the
batch; a Rice code is read from one look at the next 57 bits.

Defined cases: a null text is stored as an empty one (64 zero bytes); equal texts give equal
streams; a damaged stream raises ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, materialize, pieces

RATE, BLOCK, PAD, PCM_BLOCK, PIECE_BYTES = 44100, 1024, 64, 4096, 2 << 20
#: Coefficients of the fixed predictors of order 0 to 4 (fixed by the format).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & ((1 << bits) - 1)
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_far16 = _CRC16[None, :].copy()  # _far16[d][b]: what byte b adds to the CRC if d bytes follow


def crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each span of data (spans in order, not empty), all by table look-up."""
    global _far16
    size = end - start
    most = int(size.max())
    while len(_far16) < most:
        last = _far16[-1]
        grown = [last := ((last << np.uint16(8)) ^ _CRC16[last >> np.uint16(8)]) for _ in range(max(256, most - len(_far16)))]
        _far16 = np.concatenate([_far16, grown])
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    part = _far16[np.repeat(size, size) - 1 - place, data[np.repeat(start, size) + place]]
    return np.bitwise_xor.reduceat(part, np.cumsum(size) - size)


def crc8(header: bytes) -> int:
    c = 0
    for b in header:
        c = int(_CRC8[c ^ b])
    return c


def _coded_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    lead = (0xFF << (7 - more) & 0xFF) | n >> (6 * more)
    return bytes([lead, *(0x80 | n >> (6 * i) & 0x3F for i in range(more - 1, -1, -1))])


def _frame_header(number: int, size: int, block: int) -> bytes:
    head = b"\xff\xf8" + bytes([0x70, 0x02]) + _coded_number(number) + struct.pack(">H", size - 1)  # 16-bit size, stream's rate, mono, 8 bits
    return head + bytes([crc8(head)])


def _bit_fields(value: np.ndarray, width: np.ndarray, start: np.ndarray, total: int) -> np.ndarray:
    """Bytes with each value (at most 32 bits wide) from a bit offset on; offsets ascend and fields do not overlap."""
    word = start >> 5
    wide = value.astype(np.uint64) << (64 - (start & 31) - width).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    both = np.add.reduceat(wide, first) if len(first) else np.zeros(0, np.uint64)
    out = np.zeros(total // 32 + 3, np.uint64)
    out[word[first]] = both >> np.uint64(32)
    out[word[first] + 1] |= both & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").view(np.uint8)[: (total + 7) // 8].copy()


def _rice(folded: np.ndarray, first: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better of two Rice parameters for each frame, by its mean residual, and the bits it takes."""
    low = np.clip(np.floor(np.log2(np.maximum(1.0, total / np.maximum(1, count) * 0.6931))), 0, 13).astype(np.int64)
    length = np.diff(np.append(first, len(folded)))
    short = folded >> np.repeat(low.astype(np.uint16), length)
    bits = [np.add.reduceat(x, first, dtype=np.int64) + (k + 1) * count for k, x in ((low, short), (low + 1, short >> 1))]
    return np.where(bits[1] < bits[0], low + 1, low), np.minimum(*bits)


def encode_many(payloads: list[bytes], block: int = BLOCK, most_order: int = 4) -> list[bytes]:
    """A FLAC stream for each payload of 8-bit samples (bytes less 128), block by block.

    The order of a frame's predictor is that with the least sum of absolute residuals.
    """
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    if not len(sizes) or not sizes.sum():
        return [_container(p, [], block) for p in payloads]
    blocks = -(-sizes // block)
    owner = np.repeat(np.arange(len(payloads)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(block, sizes[owner] - number * block)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    first = np.cumsum(length) - length
    residual = raw.astype(np.int16) - np.int16(128)
    chosen, best, order = residual, None, np.zeros(len(owner), np.int64)
    for o in range(most_order + 1):
        if o:
            residual = np.diff(residual, prepend=residual[:1])
            residual[first] = 0
            for i in range(1, o):
                residual[first[length > i] + i] = 0
        size = np.add.reduceat(np.abs(residual), first, dtype=np.int64)
        if o == 1:
            constant = size == 0
        better = length > o if best is None else (size < best) & (length > o)
        if best is None:
            best = size
        else:
            best, order = np.where(better, size, best), np.where(better, o, order)
            chosen = np.where(np.repeat(better, length), residual, chosen)
    if most_order < 1:
        constant = np.maximum.reduceat(raw, first) == np.minimum.reduceat(raw, first)
    folded = (chosen << 1 ^ chosen >> 15).view(np.uint16)
    count = length - order
    rice, bits = _rice(folded, first, count, np.add.reduceat(folded, first, dtype=np.int64))
    verbatim = ~constant & (8 * order + 10 + bits >= 8 * length)
    coded = ~constant & ~verbatim
    # bodies: the warm-up samples and Rice codes of coded frames, from a byte border on
    body = np.where(coded, -(-(8 * order + 10 + bits) // 8), 0)
    base = np.cumsum(body) - body
    here = np.repeat(coded, length)
    for i in range(most_order):
        here[first[coded & (order > i)] + i] = False
    own, n = folded[here].astype(np.int64), np.where(coded, count, 0)
    k = np.repeat(rice, n)
    high = own >> k
    stop = np.cumsum(high + k + 1)
    begin = np.concatenate([[0], stop])[np.cumsum(n) - n]
    stop += np.repeat(8 * base + 8 * order + 10 - begin, n)
    packed = _bit_fields((own & ((1 << k) - 1)) | (1 << k), k + 1, stop - k - 1, 8 * int(body.sum()))
    for i in range(most_order):
        f = np.flatnonzero(coded & (order > i))
        packed[base[f] + i] = raw[first[f] + i] ^ 128
    f = np.flatnonzero(coded)  # method 0, no partitions, the parameter: ten bits
    packed[base[f] + order[f]] |= (rice[f] >> 2).astype(np.uint8)
    packed[base[f] + order[f] + 1] |= (rice[f] << 6 & 0xFF).astype(np.uint8)
    bodies, plain, out = packed.tobytes(), (raw ^ 128).tobytes(), [[] for _ in payloads]
    heads, spans = [], []
    for f, (i, n, at, kind, o, a, size) in enumerate(zip(number.tolist(), length.tolist(), first.tolist(), np.where(constant, 0, np.where(verbatim, 1, 2)).tolist(), order.tolist(), base.tolist(), body.tolist())):
        head = _frame_header(i, n, block)
        if kind == 2:
            head += bytes([(8 + o) << 1]) + bodies[a : a + size]
        else:
            head += bytes([kind << 1]) + plain[at : at + (n if kind else 1)]
        heads.append(head)
        spans.append(len(head))
    stops = np.cumsum(spans)
    checks = crc16(np.frombuffer(b"".join(heads), np.uint8), stops - spans, stops)
    for i, head, n, check in zip(owner.tolist(), heads, length.tolist(), checks.tolist()):
        out[i].append((n, head + struct.pack(">H", check)))
    return [_container(p, frames, block) for p, frames in zip(payloads, out)]


def _container(payload: bytes, frames: list[tuple[int, bytes]], block: int) -> bytes:
    samples = np.frombuffer(payload, np.uint8) ^ np.uint8(128)
    sizes = [len(f) for _, f in frames] or [0]
    info = struct.pack(">HH", block, block) + struct.pack(">I", min(sizes))[1:] + struct.pack(">I", max(sizes))[1:]
    info += struct.pack(">Q", RATE << 44 | 0 << 41 | 7 << 36 | len(payload)) + hashlib.md5(samples.tobytes()).digest()
    seek, at, first = b"", 0, 0
    for n, f in frames:
        seek += struct.pack(">QQH", first, at, n)
        first, at = first + n, at + len(f)
    return b"fLaC" + b"\x00" + struct.pack(">I", len(info))[1:] + info + b"\x83" + struct.pack(">I", len(seek))[1:] + seek + b"".join(f for _, f in frames)


class _Bits:
    """Reads bit fields at a position of its own in each lane."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = np.concatenate([data, np.zeros(16, np.uint8)])
        #: the eight bytes from each byte on, as one number
        self.words = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,)).astype(np.uint64)
        self.at = at.astype(np.int64)

    def peek(self, lanes) -> np.ndarray:
        """At least 57 bits from each lane's position on, at the top of 64."""
        at = self.at[lanes]
        return self._from(at)

    def _from(self, at: np.ndarray) -> np.ndarray:
        try:
            return self.words[at >> 3] << (at & 7).astype(np.uint64)
        except IndexError:
            raise ValueError("a residual runs past the end of its frame") from None

    def take(self, lanes, width) -> np.ndarray:
        """Unsigned fields of up to 32 bits."""
        width = np.broadcast_to(np.asarray(width, np.int64), self.at[lanes].shape)
        top = self.peek(lanes)
        out = np.where(width > 0, top >> np.maximum(1, 64 - width).astype(np.uint64), 0).astype(np.int64)
        self.at[lanes] += width
        return out

    def rice(self, lanes, k: np.ndarray) -> np.ndarray:
        """Rice codes with parameters k: zeros up to a one, then k bits."""
        at = self.at[lanes]
        top = self._from(at)
        zeros = 1075 - ((top >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)  # leading zeros, 53 bits are exact
        used = zeros + k + 1
        if used.max(initial=0) <= 57:  # a whole code is in what was read
            low = (top << (zeros + 1).astype(np.uint64) >> np.uint64(1)) >> (63 - k).astype(np.uint64)
            self.at[lanes] = at + used
            return zeros << k | low.astype(np.int64)
        high = self._unary(lanes)
        return high << k | self.take(lanes, k)

    def _unary(self, lanes) -> np.ndarray:
        """The number of zeros before the next one, which is passed, however many."""
        at = self.at[lanes].copy()
        out = np.zeros(len(at), np.int64)
        left = np.arange(len(at))
        while len(left):
            high = (self._from(at[left]) >> np.uint64(16)).astype(np.int64)  # 48 bits
            zeros = np.where(high > 0, 47 - np.floor(np.log2(np.maximum(high, 1).astype(np.float64))).astype(np.int64), 48)
            out[left] += zeros
            at[left] += zeros + (high > 0)
            left = left[high == 0]
        self.at[lanes] = at
        return out


def _signed(value: np.ndarray, width) -> np.ndarray:
    width = np.asarray(width, np.int64)
    return value - ((value >> np.maximum(width - 1, 0) & 1) << width)


def read_streams(streams: list[bytes]) -> tuple[np.ndarray, list[dict]]:
    """All bytes of the streams and, for each, its metadata and where its frames begin by its seek table."""
    infos, base = [], 0
    for s in streams:
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, seek, info = 4, b"", b""
        while True:
            kind, size = s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4], "big")
            body = s[at + 4 : at + 4 + size]
            info, seek = (body, seek) if kind == 0 else (info, body) if kind == 3 else (info, seek)
            last, at = s[at] >> 7, at + 4 + size
            if last:
                break
        word = int.from_bytes(info[10:18], "big")
        points = [struct.unpack(">QQH", seek[i : i + 18]) for i in range(0, len(seek), 18)]
        infos.append({"depth": (word >> 36 & 31) + 1, "channels": (word >> 41 & 7) + 1, "samples": word & (1 << 36) - 1, "md5": info[18:34], "frames": [(first, base + at + offset, n) for first, offset, n in points], "end": base + len(s), "rate": word >> 44})
        base += len(s)
    return np.frombuffer(b"".join(streams), np.uint8), infos


def _block_size(code: int, raw: bytes, at: int) -> int:
    """The frame's number of samples by its header's code (and the bytes at `at` for two of the codes)."""
    if code in (6, 7):
        return int.from_bytes(raw[at : at + code - 5], "big") + 1
    if code == 1:
        return 192
    return 576 << code - 2 if code < 6 else 256 << code - 8


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each mono stream with a full seek table; frames of all streams in step."""
    data, infos = read_streams(streams)
    starts = [(x[1], x[0], x[2], i) for i, info in enumerate(infos) for x in info["frames"]]
    if not starts:
        return [np.zeros(0, np.int32) for _ in streams]
    begin, first, size, owner = (np.array(c, np.int64) for c in zip(*starts))
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    stop = np.where(last, np.array([infos[i]["end"] for i in owner]), np.concatenate([begin[1:], [0]]))
    if (crc16(data, begin, stop) != 0).any():
        raise ValueError("a frame's CRC-16 is wrong")
    depth = np.array([infos[i]["depth"] for i in owner])
    raw, body = data.tobytes(), np.zeros(len(begin), np.int64)
    for f, (b, n) in enumerate(zip(begin.tolist(), size.tolist())):
        if raw[b] != 0xFF or raw[b + 1] & 0xFC != 0xF8:
            raise ValueError("no frame where the seek table points")
        at = b + 4
        lead = raw[at]
        at += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
        code = raw[b + 2] >> 4
        stated = _block_size(code, raw, at)
        at += {6: 1, 7: 2}.get(code, 0)
        at += {12: 1, 13: 2, 14: 2}.get(raw[b + 2] & 15, 0)
        if crc8(raw[b:at]) != raw[at]:
            raise ValueError("a frame header's CRC-8 is wrong")
        if stated != n:
            raise ValueError("a frame's size is not that of the seek table")
        body[f] = 8 * (at + 1)
    return _decode_frames(data, body, stop, first, size, owner, depth, infos)


def _decode_frames(data, body, stop, first, size, owner, depth, infos) -> list[np.ndarray]:
    """Frames in step: those with residuals come first, longer ones before shorter, so that at each step a range of them lives."""
    bits, every = _Bits(data, body), np.arange(len(body))
    kind = bits.take(every, 8) >> 1
    constant, verbatim, fixed, general = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | general).all():
        raise ValueError("a subframe of a reserved kind")
    coded = fixed | general
    turn = np.lexsort((-size, ~coded))
    back = np.argsort(turn)
    bits.at = bits.at[turn]
    kind, size, depth, stop, constant, verbatim, fixed, general = (x[turn] for x in (kind, size, depth, stop, constant, verbatim, fixed, general))
    n = int(coded.sum())
    out = np.zeros((int(size.max()), len(body)), np.int32)  # a row for each step
    lanes = np.flatnonzero(constant)
    if len(lanes):
        out[:, lanes] = _signed(bits.take(lanes, depth[lanes]), depth[lanes])
    order = np.where(fixed, kind - 8, np.where(general, kind - 31, 0))
    plain = np.where(verbatim, size, order)
    eights = np.flatnonzero(verbatim & (depth == 8))
    for f in eights.tolist():
        at = int(bits.at[f]) >> 3
        out[: size[f], f] = data[at : at + int(size[f])].view(np.int8)
        bits.at[f] += 8 * size[f]
        plain[f] = 0
    for i in range(int(plain.max()) if len(plain) else 0):
        lanes = np.flatnonzero((plain > i) & ~constant)
        out[i, lanes] = _signed(bits.take(lanes, depth[lanes]), depth[lanes])
    if n:
        _residuals(bits, out, size[:n], order[:n], general[:n])
    if (bits.at > 8 * (stop - 2)).any():
        raise ValueError("a subframe runs past the end of its frame")
    result, at, size = [], 0, size[back]
    for info in infos:
        frames = len(info["frames"])
        samples = np.concatenate([out[: size[f], back[f]] for f in range(at, at + frames)]) if frames else np.zeros(0, np.int32)
        at += frames
        if len(samples) != info["samples"] or info["depth"] == 8 and hashlib.md5(samples.astype(np.int8).tobytes()).digest() != info["md5"]:
            raise ValueError("the samples are not those the stream states")
        result.append(samples)
    return result


def _residuals(bits: _Bits, out: np.ndarray, size: np.ndarray, order: np.ndarray, general: np.ndarray) -> None:
    """Adds Rice residuals to the predictions of frames 0.. of out, whose warm-up samples are there; sizes descend."""
    n, most = len(size), int(order.max(initial=0))
    coefficients, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    for o, c in enumerate(FIXED[: most + 1]):
        for j, x in enumerate(c):
            coefficients[j, ~general & (order == o)] = x
    lanes = np.flatnonzero(general)
    if len(lanes):
        precision = bits.take(lanes, 4) + 1
        shift[lanes] = bits.take(lanes, 5)
        for j in range(int(order[lanes].max())):
            own = order[lanes] > j
            coefficients[j, lanes[own]] = _signed(bits.take(lanes[own], precision[own]), precision[own])
    every = slice(0, n)
    method, parts = bits.take(every, 2), bits.take(every, 4)
    if (method > 1).any():
        raise ValueError("a residual of a reserved kind")
    each = np.maximum(1, size >> parts)
    starts = np.zeros(len(out) + 1, bool)  # steps at which some frame begins a partition
    starts[order] = True
    for e in np.unique(each[parts > 0]).tolist():
        starts[::e] = True
    rice, raw_bits = np.zeros(n, np.int64), np.full(n, -1)
    alive = np.searchsorted(-size, -np.arange(len(out)), "left")  # frames longer than each step
    for i in range(int(order.min()), int(size.max())):
        live = slice(0, int(alive[i]))
        if starts[i]:
            new = np.flatnonzero((i == order[live]) | (i > order[live]) & (i % each[live] == 0))
            wide = np.where(method[new] == 0, 4, 5)
            rice[new] = bits.take(new, wide)
            raw_bits[new] = -1
            raw = new[rice[new] == (1 << wide) - 1]
            if len(raw):
                raw_bits[raw] = bits.take(raw, 5)
            escapes = bool((raw_bits >= 0).any())
        if i >= most and not escapes:
            value = bits.rice(live, rice[live])
            value = value >> 1 ^ -(value & 1)
            own = live
        else:
            own = np.flatnonzero(order[live] <= i)
            value = np.zeros(len(own), np.int64)
            coded = raw_bits[own] < 0
            code = bits.rice(own[coded], rice[own[coded]])
            value[coded] = code >> 1 ^ -(code & 1)
            rest = own[~coded]
            value[~coded] = _signed(bits.take(rest, raw_bits[rest]), raw_bits[rest])
        if min(i, most):
            guess = coefficients[0, own] * out[i - 1, own]
            for j in range(1, min(i, most)):
                guess += coefficients[j, own] * out[i - 1 - j, own]
            value += guess >> shift[own]
        out[i, own] = value


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of the text, zero bytes up to a positive multiple of 64, and the length before."""
    data = (text or "").encode()
    return data + bytes(-len(data) % PAD or (0 if data else PAD)), len(data)


def feature(samples: np.ndarray) -> str:
    """Loudness, range and zero crossings of the samples, in a fixed format."""
    x = samples.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};min={x.min()};max={x.max()};sum={x.sum()};energy={x @ x};crossings={crossings}"


def store_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of each text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                padded = [payload_of(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in padded], pa.int64()), pa.array(encode_many([p for p, _ in padded], block), pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_bytes long, media binary")


PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, samples long, blocks array<struct<first_sample: long, pcm: binary>>"


def decode_documents(media: DataFrame, block: int = PCM_BLOCK) -> DataFrame:
    """Every stored stream as PCM blocks (8 bits, unsigned), each with the offset of its first sample."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("samples", pa.int64())])
    one = pa.struct([("first_sample", pa.int64()), ("pcm", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "media", PIECE_BYTES):
                streams = part.column("media").to_pylist()
                samples = decode_many(streams)
                firsts = [np.arange(0, len(x), block) for x in samples]
                ends = np.cumsum([0, *map(len, firsts)])
                first = np.concatenate(firsts)
                size = np.minimum(block, np.repeat([len(x) for x in samples], np.diff(ends)) - first)
                pcm = (np.concatenate(samples) + 128).astype(np.uint8)
                data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(pcm)])
                blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(first, pa.int64()), data], fields=list(one)))
                rows = [[len(s) for s in streams], [hashlib.sha256(s).hexdigest() for s in streams], [len(x) for x in samples]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, f.type) for c, f in zip(rows, list(kinds)[2:])), blocks], names=[*kinds.names, "blocks"])

    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media")
    return map_batches(rows, run, PCM)


def read_samples(pcm: DataFrame, first: int, count: int) -> DataFrame:
    """doc_id and the PCM bytes of samples first to first + count (as far as there are), from the blocks that hold them."""
    begin, end = F.lit(first), F.lit(first + count)
    over = F.filter("blocks", lambda b: (b["first_sample"] < end) & (b["first_sample"] + F.octet_length(b["pcm"]) > begin))
    skip = F.greatest(begin - F.get(over, 0)["first_sample"], F.lit(0)).cast("int") + 1
    whole = F.aggregate(over, F.lit(b"").cast("binary"), lambda all_, b: F.concat(all_, b["pcm"]))
    return pcm.select("doc_id", F.coalesce(F.substring(whole, skip, F.lit(count)), F.lit(b"")).alias("pcm"))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pcm_digests(pcm: DataFrame) -> DataFrame:
    """Describes what is read back from stored PCM blocks."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "blocks", PIECE_BYTES):
                blocks = part.column("blocks")
                each, bounds = blocks.flatten().field("pcm").to_pylist(), np.append(0, np.cumsum(pc.list_value_length(blocks).to_numpy(zero_copy_only=False))).tolist()
                rows = []
                for a, b in zip(bounds, bounds[1:]):
                    back = b"".join(each[a:b])
                    samples = np.frombuffer(back, np.uint8).astype(np.int64) - 128
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), feature(samples)))
                n, sha, crc, what = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), part.column("media_bytes"), part.column("media_sha256"), pa.array(what)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return map_batches(pcm, run, DIGEST)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcm = decode_documents(store_documents(documents(spark, sf_dir)))
    return pcm_digests(materialize(pcm, "pcm"))
