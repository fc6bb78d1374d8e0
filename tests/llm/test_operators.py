"""Each operator against brute force on a small corpus with awkward rows, and on an empty table."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import bpe_automaton, byte_tokens, common, components, flac, language_id, licenses, lm_scoring, near_duplicates, packing, quality, sharding, substrings

R = random.Random(3)
FRAGMENTS = "an the ing tion er ou re on st ha".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_key` string, row string, f0 string, score string, kept string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def word():
    return "".join(R.choice(FRAGMENTS) for _ in range(R.randint(1, 3)))


def prose(n):
    return " ".join(word() + R.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus():
    base = [prose(R.randint(1, 120)) for _ in range(60)]
    near = base[7].split(" ")
    passage = " ".join(word() for _ in range(60)) + "."
    texts = base + [base[3]] * 5 + [" ".join(near[:-1] + ["changed"]), " ".join(["Start"] + near)]
    texts += [base[10] + "\n" + passage, passage + "\n" + base[11], None, "", "   \n\t", "1 2 3", "x", "Word " * 3000, "Éß中文 ﬁ ½ <|endoftext|> 😀\x1c\x85 it's"]
    texts += ["Released under the MIT License.\nmore", "see the Apache\nLicense here", "Licensed under the Apache License, Version 2.0", "licensed under cc by nc 4 0 and so on"]
    rows = [(i, t, R.choice(["en", "fr", None]), R.choice(["a", "b", None]), None if t is None else len(t), "k", "r", "f", "s", "y") for i, t in enumerate(texts)]
    return rows + [(None, "no id", None, None, None) + ("k",) * 5, rows[5], rows[5]]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower().decode()


def test_shards_are_minimal_and_whole(docs, nothing):
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == len(ROWS)
    by_shard, by_key = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r)
        by_key[r["text_crc32"]].add(r["shard"])
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by_shard.values())
    assert all(len(s) == 1 for s in by_key.values())
    groups = collections.Counter()
    for r in rows:
        groups[r["key"]] += r["size"]
    order, total, shards, alone = [g for _, g in sorted(groups.items())], sum(groups.values()), 5, []
    for g in sorted(order, reverse=True):  # groups over the fair share of the rest stand alone
        if len(alone) < shards - 1 and g * (shards - len(alone)) > total:
            alone.append(g)
            order.remove(g)
            total -= g

    def fits(capacity):
        n, used = 1, 0
        for g in order:
            if g > capacity:
                return False
            if used + g > capacity:
                n, used = n + 1, 0
            used += g
        return n <= shards - len(alone)

    best = next(c for c in range(1, total + 1) if fits(c))
    assert max(sum(r["size"] for r in own) for s, own in by_shard.items() if s >= len(alone)) == best
    assert sharding.shard_documents(nothing, 5).count() == 0


def labels_by_hand(words, templates=licenses.TEMPLATES):
    """Labels of blocks with enough words of a template, but for those whose first best block meets a fuller one."""
    found = []
    for label, text in templates:
        own, block = set(licenses.words_of(text)), licenses.block_size(text)
        least = licenses.needed(len(own), 0.8)
        at = [i for i, w in enumerate(words) if w in own]
        if len({words[i] for i in at}) < least:
            continue
        shared = {i: len({words[j] for j in at if i <= j < i + block}) for i in at}
        if max(shared.values()) >= least:
            start = min(i for i in at if shared[i] == max(shared.values()))
            found.append((label, max(shared.values()) / len(own), start, start + block))
    return {x[0] for x in found if not any(o[1] > x[1] and o[2] < x[3] and x[2] < o[3] for o in found)}


def test_license_labels_and_places(docs, nothing):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan_licenses(docs).collect()}
    for doc_id, text, *_ in ROWS:
        words = re.findall(licenses.WORD, lower(text))
        r = got[doc_id, len(words)]
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert r["n_base"] == len(places)
        assert r["first_word"] == min((p for p, _ in places), default=None) and r["last_word"] == max((p for p, _ in places), default=None)
        assert r["labels"] == ",".join(sorted(labels_by_hand(words) | {label for _, label in places}))
    assert licenses.scan_licenses(nothing).count() == 0


def test_licenses_in_code_comments_and_torn_ones(spark):
    """Whole passages in comments, passages with words lost, spread or repeated, in long texts, against a plain loop."""
    r, rows = random.Random(12), []
    for _, text in licenses.TEMPLATES:
        words = text.split()
        rows.append("\n".join(f" * {' '.join(words[i : i + 7])}" for i in range(0, len(words), 7)))
        rows.append(prose(300) + "\n" + " ".join(w for w in words if r.random() > 0.18).upper() + "\n" + prose(300))
        rows.append(" ".join(x for w in words for x in [w, *([word()] * (r.random() < 0.4))]))
        rows.append(" ".join(f"{w} {prose(4)}" for w in words))
    rows += [" ".join(r.choice(["the", "license", "software", "of", "permission", "copyright", word()]) for _ in range(20_000)), "MIT\u0130LICENSE \u212a mit license"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for x in licenses.scan_licenses(docs).collect():
        words = re.findall(licenses.WORD, lower(rows[x["doc_id"]]))
        assert set(x["labels"].split(",")) - {""} == labels_by_hand(words) | set(x["base_labels"].split(",")) - {""}


def test_of_licenses_in_one_block_the_fullest_stays(spark):
    by = dict(licenses.TEMPLATES)
    rows = [by["gpl-2.0-header"], by["mit-disclaimer"], by["gpl-2.0-header"] + " " + prose(200) + " " + by["gpl-3.0-header"], by["isc"], by["postgresql"]]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert "gpl-2.0-header" in got[0] and not got[0] & {"agpl-3.0", "gpl-3.0-header", "lgpl-2.1-header"}
    assert "mit-disclaimer" in got[1] and "bsd-disclaimer" not in got[1]
    assert {"gpl-2.0-header", "gpl-3.0-header"} <= got[2] and "agpl-3.0" not in got[2]
    assert "isc" in got[3] and "postgresql" in got[4] and "isc" not in got[4]


def test_text_that_stands_nowhere_else_is_kept(spark):
    line = " ".join(word() for _ in range(12))
    rows = [(1, line), (2, f"{line}\nUnique fact 42\n{line}"), (3, f"{line}\nshort\n\nother"), (4, f"a b\n{line}\nc d")]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == line and got[2]["text"] == "Unique fact 42\n" and got[3]["text"] == "short\n\nother" and got[4]["text"] == "a b\nc d"
    assert got[2]["n_removed"] == 2 and [(s["start"], s["end"]) for s in got[2]["kept_spans"]] == [(len(line) + 1, len(line) + 16)]


def test_every_language_has_a_dictionary(spark):
    """Few distinct texts among very many rows, and texts that share all their lines."""
    german = "der Hund und die Katze gehen heute nicht über die Straße, weil es dort zu laut ist"
    french = "le chat et le chien ne vont pas dans la rue\nparce que le soleil est trop haut"
    rows = [(f"the house by the river number {i} was sold to {word()} and {word()} last year", "en") for i in range(300)] + [(german, "de")] * 5000 + [(french, "fr"), (french + "\n", "fr")]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    found = language_id.fit_dictionaries(docs)
    assert sorted(found) == ["de", "en", "fr"] and "hund" in found["de"].decode() and "soleil" in found["fr"].decode()
    asked = spark.createDataFrame([(1, "die Katze und der Hund gehen heute nicht über die Straße"), (2, "le chien et le chat ne vont pas dans la rue"), (3, "the house by the river was sold last year")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.classify(asked, found).orderBy("doc_id").collect()] == ["de", "fr", "en"]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(docs, nothing, words):
    got = {(r["doc_id"], r["n_shingles"]): r for r in near_duplicates.near_duplicates(docs, words).collect()}
    sets = []
    for doc_id, text, *_ in ROWS:
        w = WORD.findall(lower(text))
        sets.append((doc_id, frozenset(zip(*(w[i:] for i in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for i, (doc_id, s) in enumerate(sets):
        group = [d for j, (d, _) in enumerate(sets) if find(j) == find(i) and d is not None]
        r = got[doc_id, len(s)]
        assert r["component_id"] == (min(group) if group and s else doc_id)
        assert r["kept"] == (r["component_id"] == doc_id)
    assert near_duplicates.near_duplicates(nothing, words).count() == 0


def test_registers_are_those_of_the_least_member():
    rng = np.random.default_rng(2)
    for size in (1, 40, 1000, 100_000):
        own = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        regs = near_duplicates.registers(own, np.array([0, len(own)]), 180)[0]
        least = {}
        for h in own.tolist():
            bucket, rest = h * 180 >> 64, h * 180 & 2**64 - 1
            least[bucket] = min(rest, least.get(bucket, rest))
        for b in range(180):
            if b not in least:
                assert regs[b] == near_duplicates.EMPTY
            else:
                bits = f"{least[b]:064b}"
                zeros = len(bits) - len(bits.lstrip("0"))
                assert regs[b] == zeros << 10 | int((bits + "0" * 64)[zeros + 1 : zeros + 11], 2)
        if size >= 1000:
            assert abs((regs >> 10).mean() - np.log2(size / 180)) < 1.5


@pytest.mark.parametrize("n, m", [(30, 30), (180, 400), (3000, 3000), (500, 20_000)])
def test_expected_collisions_agree_with_simulation(n, m):
    rng = np.random.default_rng(n)
    equal, turns = 0, 1500
    for at in range(0, turns, 50):
        both = [rng.integers(0, 2**64, (50, k), dtype=np.uint64) for k in (n, m)]
        regs = [near_duplicates.registers(np.sort(x, 1).ravel(), np.arange(51) * x.shape[1], 180) for x in both]
        equal += int(((regs[0] == regs[1]) & (regs[0] != near_duplicates.EMPTY)).sum())
    want = float(near_duplicates.expected_collisions(n, m, 180)) * turns
    assert abs(equal - want) < 5 * np.sqrt(want) + 3


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(8)
    for n, same in ((400, 320), (2000, 1700), (5000, 1000), (60, 50)):
        found = []
        for _ in range(60):
            x = rng.integers(0, 2**64, 2 * n - same, dtype=np.uint64)
            sets = [np.sort(x[:n]), np.sort(x[n - same :])]
            regs = near_duplicates.registers(np.concatenate(sets), np.array([0, n, 2 * n]), 180)
            found.append(near_duplicates.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0][0])
        assert abs(np.mean(found) - same / (2 * n - same)) < 0.03


def test_null_ids_lose_no_links(spark):
    rows = [(None, "t u v w"), (5, "t u v w"), (7, "t u v w"), (None, "p q r s"), (None, "p q r s"), (None, "p q r s r"), (3, None), (None, None), (8, "t u v w")]
    rows += [(i, f"copy of the same text with a word {'x' * (i % 40)}" + " and a long tail of words that all have" * 3) for i in range(100, 700)]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[5] == {(5, True)} and by[7] == by[8] == {(5, False)} and by[3] == {(3, True)}
    assert {r["component_id"] for r in out if r["doc_id"] is None and r["n_shingles"] == 3} == {5, None}
    assert all(by[i] == {(100, i == 100)} for i in range(100, 700))


def test_all_pairs_of_a_small_table_agree(spark):
    """Every link that all pairs of the documents have is there: recall and precision 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts, sets = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    by_size = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    links = [(a, b) for k, b in enumerate(by_size) for a in by_size[:k] if 100 * len(sets[a]) >= 80 * len(sets[b]) and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs, 2).collect()}
    assert links and all(got[i]["component_id"] == label[i] and got[i]["n_shingles"] == len(sets[i]) for i in sets)


@pytest.mark.parametrize("most", [0, 100_000])
def test_components_of_stars_chains_and_loops(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SMALL_ROWS", most)
    rng = random.Random(6)
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000), (3001, 3000), (3001, 3000)]
    links += [(rng.randint(5000, 5200), rng.randint(5000, 5200)) for _ in range(150)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links + [(None, 4)], "a long, b long")).collect()}
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert got == want
    parts = spark.createDataFrame([(x, x) for x in want], "node long, component long")
    for some in (links[:300], links[300:], links[:5]):
        parts = components.merged(parts, spark.createDataFrame([x for x in some if x[0] != x[1]], "a long, b long"))
    assert {r["node"]: r["component"] for r in parts.collect()} == want


def test_salted_joins_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_ROWS", 10)
    rows = [(1 if i % 3 else i, i, "x" * (i % 5)) for i in range(3000)] + [(None, -1, "n")]
    left = spark.createDataFrame(rows, "k long, i long, t string")
    counts = collections.Counter(r[0] for r in rows if r[0] != 6)
    table = spark.createDataFrame([(k, f"v{k}", n) for k, n in counts.items()], "k long, v string, n long")
    for how in ("inner", "left"):
        got = common.join_counted(left, table, ["k"], "n", how)
        assert got.columns == ["k", "i", "t", "v", "n"]
        want = [(k, i, t, f"v{k}" if k is not None and k != 6 else None, counts[k] if k is not None and k != 6 else None) for k, i, t in rows if how == "left" or k is not None and k != 6]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_open_pairs_lose_no_link(spark):
    """A family around the threshold in one bucket: the bounded pairs hold all its links."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.05, 0.12, 0.2]), rng.integers(0, 400, 60), base)) for _ in range(60)]
    placed = spark.createDataFrame([(1, i, i) for i in range(60)], "bucket long, class_id long, component long")
    table = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "class_id long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in near_duplicates.open_pairs(placed, table, 80).collect()}
    links = {(i, j) for j in range(60) for i in range(j) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)}
    assert links and links <= got and len(got) < 60 * 59 // 2


def test_automaton_equals_the_library(docs, nothing):
    from tokenizers import Tokenizer

    path = byte_tokens.default_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in bpe_automaton.encode_documents(docs, path).collect()}
    for doc_id, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (doc_id, digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False)), len(ids)) in got
    assert bpe_automaton.encode_documents(nothing, path).count() == 0


def test_packing_holds_every_id_once(docs, nothing):
    from tokenizers import Tokenizer

    path = byte_tokens.default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    times = collections.Counter((r[0], r[1]) for r in ROWS)
    for (doc_id, text), n in times.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want = [(s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
        assert sorted(pieces[doc_id]) == sorted(want * n)
    filled = sum(x[1] for own in sequences.values() for x in own)
    assert filled >= 0.9 * 2048 * (len(sequences) - 1)
    assert packing.pack_documents(nothing, path).count() == 0


def test_first_fit_decreasing_is_first_fit():
    sizes = np.array([R.randint(1, 2048) for _ in range(400)])
    bins, offsets = packing.first_fit_decreasing(sizes, 2048)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(2048)
        assert (bins[i], offsets[i]) == (b, 2048 - free[b])
        free[b] -= sizes[i]


def test_flac_round_trip(docs, nothing):
    pcm = flac.decode_documents(flac.store_documents(docs), 256)
    got = {(r["doc_id"], r["payload_sha256"]): r for r in flac.pcm_digests(pcm).collect()}
    for doc_id, text, *_ in ROWS:
        payload, n = flac.payload_of(text)
        r = got[doc_id, hashlib.sha256(payload).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, len(payload), zlib.crc32(payload[-64:]))
    for r in pcm.collect():
        assert [b["first_sample"] for b in r["blocks"]] == list(range(0, r["samples"], 256))
    by_id = {i: flac.payload_of(t)[0] for i, t, *_ in ROWS}
    for first, count in ((0, 10), (250, 20), (300, 1000), (10**6, 5)):
        for r in flac.read_samples(pcm.where("doc_id is not null"), first, count).collect():
            assert bytes(r["pcm"]) == by_id[r["doc_id"]][first : first + count]
    assert flac.pcm_digests(flac.decode_documents(flac.store_documents(nothing))).count() == 0


def test_any_bytes_come_back():
    r = np.random.default_rng(5)
    payloads = [r.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 2, 3, 5, 1024, 1025, 5000)]
    payloads += [b"", bytes(7), b"\xff" * 3000, bytes(np.cumsum(r.integers(-3, 4, 9000)).astype(np.uint8)), bytes((128 + 120 * np.sin(np.arange(4096) / 9)).astype(np.uint8)), b"a" * 1024 + bytes(r.integers(0, 256, 1024).astype(np.uint8))]
    for order in range(5):
        for block in (16, 1024):
            got = flac.decode_many(flac.encode_many(payloads, block, order))
            assert [(x + 128).astype(np.uint8).tobytes() for x in got] == payloads


def _linear_stream(samples, coefficients, shift, precision=8, rice=3, escape=False):
    """A FLAC stream of one frame with a general predictor, made bit by bit."""
    bits = f"{32 + len(coefficients) - 1:06b}".join(["0", "0"])
    put = lambda v, n: f"{v & ((1 << n) - 1):0{n}b}"
    order = len(coefficients)
    bits += "".join(put(s, 8) for s in samples[:order]) + put(precision - 1, 4) + put(shift, 5) + "".join(put(c, precision) for c in coefficients)
    bits += "00" + "0000" + (put(15, 4) + put(12, 5) if escape else put(rice, 4))
    for i in range(order, len(samples)):
        r = samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefficients)) >> shift)
        z = r << 1 ^ r >> 31
        bits += put(r, 12) if escape else "0" * (z >> rice) + "1" + put(z, rice)
    bits += "0" * (-len(bits) % 8)
    frame = flac._frame_header(0, len(samples), 64) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    data = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(data, np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")
    return flac._container(bytes((s + 128) & 255 for s in samples), [(len(samples), frame)], 64)


@pytest.mark.parametrize("escape", [False, True])
def test_general_predictors_and_escapes_decode(escape):
    samples = [int(40 * np.sin(i / 5)) for i in range(64)]
    stream = _linear_stream(samples, [14, -7], 3, escape=escape)
    assert flac.decode_many([stream])[0].tolist() == samples
    broken = bytearray(stream)
    broken[-9] ^= 4
    with pytest.raises(ValueError):
        flac.decode_many([bytes(broken)])


def test_language_is_the_dictionary_that_fits(spark, nothing):
    make = {"aa": lambda: " ".join(R.choice(["lorem", "ipsa", "dolor", "amet"]) + R.choice("aeiou") for _ in range(40)), "bb": lambda: " ".join(R.choice(["quick", "brown", "foxes", "jump"]) + R.choice("xyz") for _ in range(40))}
    rows = [(i, make[lang](), lang) for i, lang in enumerate(["aa", "bb"] * 60)] + [(200, None, "aa"), (201, "12 + 3", "bb"), (202, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.classify(docs, language_id.fit_dictionaries(docs.where("doc_id % 4 <> 2"))).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows[:120])
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (200, 201, 202))
    assert language_id.fit_dictionaries(nothing) == {}
    assert language_id.classify(nothing, {}).count() == 0


def brute_counts(text):
    words = WORD.findall(text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        lines += line in seen and bool(WORD.search(line))
        seen.add(line)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)


def test_quality_counts_and_verdicts(docs, nothing):
    counts = quality.with_counts(docs)
    got = {(r["doc_id"], *(r[c] for c in quality.COUNTS)): r for r in quality.judge(counts, quality.fit_cells(counts)).collect()}
    for doc_id, text, *_ in ROWS:
        r = got[(doc_id, *brute_counts(text))]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["f0"] in ("f", "k") and r["own_kept"] in ("y", "k")
    empty = quality.with_counts(nothing)
    assert quality.judge(empty, quality.fit_cells(empty)).count() == 0


def test_repeated_passages_go_but_for_the_first(docs, nothing):
    out = substrings.remove_repeats(docs).collect()
    assert len(out) == len(ROWS)
    passage = ROWS[67][1].split("\n")[1]
    holders = [r["doc_id"] for r in out if passage in (r["text"] or "")]
    assert holders == [67]
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[68]["text"] == "" and by_id[67]["text"] == passage  # their other lines stand in documents 10 and 11
    assert by_id[11]["text"] == ROWS[11][1] and by_id[0]["text"] == ROWS[0][1]
    for r in out:
        original = next(t for i, t, *_ in ROWS if i == r["doc_id"])
        assert (r["text"] or "") == "".join((original or "")[s["start"] : s["end"]] for s in r["kept_spans"]) and r["_key"] == "k"
    first = {}
    for doc_id, text, *_ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        kept = {u for _, _, u in substrings.units(by_id[doc_id]["text"] or "") if u}
        for u in kept & set(first):
            assert first[u] == doc_id
        for _, _, u in substrings.units(text or ""):
            if u:
                first.setdefault(u, doc_id)
    assert substrings.remove_repeats(nothing).count() == 0


def test_base_scores_and_gradient(docs, nothing):
    path = byte_tokens.default_path("byte_bpe_50k.json")
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_scoring.score_documents(docs, path).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter()
    for doc_id, text, *_ in ROWS:
        if not held(doc_id):
            counts.update([*WORD.findall(lower(text)), None])
    n, v = sum(counts.values()), len(counts)
    for doc_id, text, *_ in ROWS:
        tokens = [*WORD.findall(lower(text)), None]
        r = got[doc_id, len(tokens)]
        assert r["held_out"] == held(doc_id) and r["train_tokens"] == n and r["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert abs(r["base_score"] - sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-6 * len(tokens)
        assert r["score"] < 0
    assert lm_scoring.score_documents(nothing, path).count() == 0


def windows(ids, counts, vocabulary):
    inputs, targets, _ = lm_scoring.blocks_of(ids, counts, vocabulary.end_id)
    at = np.flatnonzero(targets[:, 0] >= 0)
    x = np.where(inputs < 0, lm_scoring.PAD, vocabulary.symbol[inputs])
    return np.concatenate([x[at - 1], x[at]], 1), targets[at]


def test_model_is_causal_and_learns():
    rng = np.random.default_rng(0)
    vocabulary = lm_scoring.Vocabulary(np.arange(3000, 0, -1), 2999)
    p = lm_scoring.initial(vocabulary)
    x = rng.integers(0, 50, (64, 32))
    target = np.concatenate([x[:, 17:], x[:, :1]], 1) % 40
    weight = np.ones(target.shape, np.float32)
    states, _ = lm_scoring.forward(p, lm_scoring.tables(p), x)
    other = x.copy()
    other[:, 25:] = 7
    changed, _ = lm_scoring.forward(p, lm_scoring.tables(p), other)
    same = np.isclose(states, changed, atol=1e-4).all(1).reshape(64, 16)
    assert same[:, :9].all() and not same[:, 9:].all()
    before, _ = lm_scoring.loss_and_gradient(p, x, target, weight)
    after, _ = lm_scoring.loss_and_gradient(lm_scoring.train(p, x, target, weight, epochs=60, batch=64), x, target, weight)
    assert after < before - 0.5


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    vocabulary = lm_scoring.Vocabulary(np.arange(6000, 0, -1), 5999)
    p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in lm_scoring.initial(vocabulary).items()}
    x, targets = windows(rng.integers(0, 50, 300), np.array([100, 0, 7, 193]), vocabulary)
    cell, weight = vocabulary.cell[targets], (targets >= 0).astype(np.float32)
    _, d = lm_scoring.loss_and_gradient(p, x, cell, weight)
    for k in p:  # along the gradient itself, where rounding matters least
        size = np.sqrt((d[k].astype(float) ** 2).sum())
        if size > 1e-5:
            step = d[k] / size * 3e-2
            up, down = (lm_scoring.loss_and_gradient(p | {k: p[k] + sign * step}, x, cell, weight)[0] for sign in (1, -1))
            assert abs((up - down) / 6e-2 - size) < 0.03 * size + 2e-4, k


def test_training_steps_equal_plain_ones_without_tables_of_all_symbols():
    """Gradients fill the array they are given, Adam in place equals a plain one, and no step makes keys and values of every symbol."""
    rng = np.random.default_rng(8)
    vocabulary = lm_scoring.Vocabulary(np.arange(6000, 0, -1), 5999)
    x, targets = windows(rng.integers(0, 3000, 2900), np.array([1400, 0, 70, 1430]), vocabulary)
    cell, weight = vocabulary.cell[targets], (targets >= 0).astype(np.float32)
    start = lm_scoring.initial(vocabulary)
    assert lm_scoring.tables(start).size < lm_scoring.PAD  # a map, not a row of numbers for each symbol
    into = np.full(lm_scoring.SIZE, 7, np.float32)  # what stood there before is gone
    for n in (1, 8, 13):  # of rows in runs of one block and of eight
        one, d = lm_scoring.loss_and_gradient(start, x[:n], cell[:n], weight[:n], lm_scoring.views(into))
        parts = [lm_scoring.loss_and_gradient(start, x[i : i + 1], cell[i : i + 1], weight[i : i + 1]) for i in range(n)]
        share = [weight[i].sum() / weight[:n].sum() for i in range(n)]
        assert abs(one - sum(a * loss for a, (loss, _) in zip(share, parts))) < 1e-4
        assert np.allclose(into, sum(a * lm_scoring.flat(g).astype(float) for a, (_, g) in zip(share, parts)), atol=1e-5)
    now, m, v, t, order = lm_scoring.flat(start).astype(float), 0.0, 0.0, 0, np.random.default_rng(3).permutation(len(x))
    last = -(-len(x) // 64)
    for at in range(0, len(x), 64):
        own = order[at : at + 64]
        g = lm_scoring.flat(lm_scoring.loss_and_gradient(lm_scoring.shaped(now), x[own], cell[own], weight[own])[1]).astype(float)
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        now = now - lm_scoring.RATE * (1 - 0.9 * t / last) / (1 - 0.9**t) * m / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    got = lm_scoring.flat(lm_scoring.train(start, x, cell, weight, seed=3))
    assert np.abs(got - now).mean() < 1e-5 and np.abs(got - lm_scoring.flat(start)).mean() > 1e-3


def test_scores_equal_a_loop_over_tokens():
    """Each id once, by a plain float64 model of its own window; extreme parameters give numbers, and cells sum to one."""
    rng = np.random.default_rng(4)
    vocabulary = lm_scoring.Vocabulary(rng.integers(0, 100, 5000), 4999)
    counts = np.array([0, 1, 15, 16, 17, 70])
    ids = rng.integers(0, 4999, counts.sum())
    for scale in (0.1, 30.0):
        p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(scale if k in ("near", "key") else 0.1) for k, v in lm_scoring.initial(vocabulary).items()}
        stream, got = lm_scoring.token_scores(vocabulary, p, lm_scoring.tables(p), ids, counts, step=3)
        want, at = [], 0
        q = {k: v.astype(float) for k, v in p.items()}
        for n in counts:
            own = ids[at : at + n].tolist() + [vocabulary.end_id]
            seen = [vocabulary.symbol[i] for i in [vocabulary.end_id, *own[:-1]]]
            at += n
            for i, target in enumerate(own):
                first = max(0, (i // 16 - 1) * 16)
                e = q["embed"][seen[first : i + 1]]
                s = e @ q["key"] @ (q["query"].T @ e[-1]) / np.sqrt(lm_scoring.WIDTH) + q["near"][i - np.arange(first, i + 1)]
                s = np.exp(s - s.max())
                h = e[-1] + (s / s.sum()) @ (e @ q["value"])
                h = h + np.maximum(0, h @ q["up"] + q["up_bias"]) @ q["down"]
                group, member = divmod(int(vocabulary.cell[target]), lm_scoring.MEMBERS)
                a, b = h @ q["group"] + q["group_bias"], h @ q["member"][group] + q["member_bias"][group]
                log = a[group] - a.max() - np.log(np.exp(a - a.max()).sum()) + b[member] - b.max() - np.log(np.exp(b - b.max()).sum())
                want.append((log + vocabulary.share[target]) / np.log(10))
        assert stream.tolist() == [i for k, n in enumerate(counts) for i in [*ids[counts[:k].sum() : counts[: k + 1].sum()], vocabulary.end_id]]
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=2e-3, atol=2e-3)
    total = np.bincount(vocabulary.cell, np.exp(vocabulary.share), lm_scoring.CELLS)
    assert np.allclose(total[total > 0], 1, atol=1e-3)


def test_training_takes_every_block_of_every_text_once(docs):
    """One round has every block of every training text, once; several rounds have them all, and none twice."""
    path = byte_tokens.default_path("byte_bpe_50k.json")
    encoded = lm_scoring.encode_texts(docs, path).cache()
    own = lm_scoring.word_ids(path)
    read = lambda rounds: [(r["turn"], r["key"], np.frombuffer(r["window"], "<i4")) for r in lm_scoring.training_windows(encoded, path, rounds).collect()]
    whole = read(1)
    got = collections.Counter(i for _, _, w in whole for i in w[32:].tolist() if i >= 0)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [[own.coder.ranked.encode_ordinary(" " + w) for w in WORD.findall(lower(t))] for i, t, *_ in ROWS if not held(i)]
    assert got == collections.Counter(i for t in texts for i in [*(x for w in t for x in w), own.end_id])
    parts = read(4)
    assert {t for t, _, _ in parts} == {0, 1, 2, 3} and sorted(w.tobytes() for _, _, w in parts) == sorted(w.tobytes() for _, _, w in whole)
    assert {r["id"]: r["n"] for r in encoded.where("id is not null").groupBy("id").agg(F.sum("c").alias("n")).collect()} == got
    encoded.unpersist()


def test_training_shuffles_ids_and_not_windows(spark):
    """Runs hold an id in about two bytes, once but for what stands before them, and give the windows that blocks of whole texts give."""
    path = byte_tokens.default_path("byte_bpe_50k.json")
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in zip((i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2), (0, 1, 5, 60, 700, 3000))]
    encoded = lm_scoring.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), path).cache()
    own, want, n = lm_scoring.word_ids(path), [], 0
    for r in encoded.where("ids is not null").collect():
        ids = np.frombuffer(r["ids"], own.kind)
        n += len(ids) + 1
        inputs, targets, _ = lm_scoring.blocks_of(ids, np.array([len(ids)]), own.end_id)
        want += [np.concatenate([inputs[k - 1], np.where(targets[k] < 0, -1, inputs[k]), targets[k]]).astype("<i4").tobytes() for k in range(1, len(inputs))]
    assert sorted(bytes(r["window"]) for r in lm_scoring.training_windows(encoded, path).collect()) == sorted(want)
    assert sum(len(r["run"]) for r in lm_scoring.training_runs(encoded, path).collect()) < 2.5 * n
    encoded.unpersist()


def test_frequent_ids_are_shuffled_in_a_byte(spark):
    """Packed ids come back, and packed runs hold the same ids in fewer bytes."""
    rank = np.random.default_rng(2).permutation(70_000).astype(np.int32)
    by_rank = np.argsort(rank)
    for ids in (np.zeros(0, int), by_rank[[0, 127, 128, 16383, 16384, 69_999]], np.arange(70_000)):
        data, bounds = lm_scoring.packed(ids, rank)
        assert np.array_equal(lm_scoring.unpacked(data.tobytes(), by_rank), ids) and len(bounds) == len(ids) + 1
        assert np.diff(bounds).tolist() == [1 + (r >= 128) + (r >= 16384) for r in rank[ids]]
    path = byte_tokens.default_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "the old and the new of the same " * 90) for i in range(6)], "doc_id long, text string")
    encoded = lm_scoring.encode_texts(docs, path).cache()
    own = lm_scoring.word_ids(path)
    used = np.unique(np.concatenate([np.frombuffer(r["ids"], own.kind) for r in encoded.where("ids is not null").collect()]))
    by_rank = np.append(used, np.setdiff1d(np.arange(own.size), used))
    rank = np.argsort(by_rank)
    plain = lm_scoring.training_runs(encoded, path).collect()
    small = [r for turn in range(lm_scoring.ROUNDS) for r in lm_scoring.training_runs(encoded, path, turn=turn, rank=rank).collect()]
    read = lambda r, ids: (r["turn"], r["key"], r["head"], ids.tolist())
    assert sorted(read(r, np.frombuffer(r["run"], own.kind)) for r in plain) == sorted(read(r, lm_scoring.unpacked(r["run"], by_rank)) for r in small)
    assert sum(len(r["run"]) for r in small) < 0.6 * sum(len(r["run"]) for r in plain)
    encoded.unpersist()


def test_memory_counts_what_other_texts_have(spark):
    """What the memory adds, by a loop over segments; a text of the training part does not see itself."""
    rows = [(1, False, [(10, 11, -20.0), (11, 12, -30.0)]), (2, False, [(10, 11, -20.0), (11, 13, -25.0)]), (3, True, [(10, 11, -20.0), (11, 14, -5.0)]), (4, False, [(50, 51, -9.0)]), (5, True, [(50, 51, -9.0)]), (6, True, [(60, 61, -9.0)]), (7, True, [(60, 61, -9.0)]), (8, False, [(70, 71, -1.0)])]
    scored = spark.createDataFrame(rows, "row_key long, held_out boolean, pairs array<struct<ctx: long, seg: long, net: double>>")
    got = {r["row_key"]: r["x"] for r in lm_scoring.remembered(scored).groupBy("row_key").agg(F.sum("recalled").alias("x")).collect()}
    c, all_c, all_n = collections.Counter(), collections.Counter(), collections.Counter()
    for _, held, pairs in rows:
        for t, s, _ in pairs:
            c[t, s] += not held
            all_c[t] += not held
            all_n[t] += 1
    for key, held, pairs in rows:
        want = 0.0
        for t, s, net in pairs:
            if all_n[t] > 1 and all_c[t]:
                mine, every = c[t, s] - (not held), all_c[t] - (not held)
                want += (np.log10(mine + 10**net) if mine else net) - np.log10(every + 1) - net
        assert abs(got.get(key, 0.0) - want) < 1e-9


def test_copies_score_apart_from_texts_that_stand_once(spark):
    """Of new texts, those that occur twice in the training part are far likelier than those that stand once."""
    r = random.Random(9)
    new = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(300))
    once, twice = [new() for _ in range(30)], [new() for _ in range(10)]
    texts = once + twice + twice
    rows = [(i, t) for i, t in zip((i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2), texts)]
    out = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), byte_tokens.default_path("byte_bpe_50k.json")).collect()
    score = {r["doc_id"]: (r["score"] + r["recalled"]) / r["n_tokens"] for r in out}
    alone = {r["doc_id"]: r["score"] / r["n_tokens"] for r in out}
    ids = [i for i, _ in rows]
    assert all(abs(alone[a] - alone[b]) < 1e-4 for a, b in zip(ids[30:40], ids[40:]))
    assert min(score[i] for i in ids[30:]) > 0.5 * max(score[i] for i in ids[:30])
    assert all(abs(score[a] - score[b]) < 1e-4 for a, b in zip(ids[30:40], ids[40:]))


def test_training_gains_on_texts_held_out(spark, monkeypatch):
    """Held-out texts of the given tables: far likelier than without training, and near the counts that need not spell a word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = byte_tokens.default_path("byte_bpe_50k.json")

    def held():
        r = lm_scoring.score_documents(docs, path).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score"), F.sum(F.col("score") + F.col("recalled"))).first()
        return [x / r[0] for x in r[1:]]

    base, trained, recalled = held()
    monkeypatch.setattr(lm_scoring, "fit", lambda encoded, path, rounds, real=lm_scoring.fit: real(encoded, path, 0))
    untrained = held()[1]
    assert trained > untrained + 1.5 and trained > base - 0.15 and recalled > base


def test_automaton_keeps_words_that_begin_with_nul(spark):
    from tokenizers import Tokenizer

    path = byte_tokens.default_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["ab \0 cd \0!! x", "\0", "\0\0 \0a", "\0<|endoftext|>\0 <|endoftext|>", " \0 ", "a\0b \0<|endoftext|"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_automaton.encode_documents(docs, path).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))), text


def test_repeats_in_short_lines_and_paragraphs_go(spark):
    verse = "\n".join(f"verse {i} goes {chr(97 + i)}" for i in range(20))
    chinese = "".join(chr(0x4E00 + 7 * i) for i in range(30)) + "\n" + "".join(chr(0x5E00 + 11 * i) for i in range(30))
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [verse, f"a title\n{verse}\nan end", chinese, f"\u6807\u9898\n{chinese}", prose, "head\n\n" + prose.replace("eleven ", "eleven\n").replace("five ", "five\n") + "\n\ntail"]
    texts += ["\n".join(["la la la"] * 20), "short line\nanother line\nthird one", "la la la\nnothing else"]
    rows = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    got = [rows[i]["text"] for i in range(len(texts))]
    assert got[0] == verse and got[2] == chinese and got[4] == prose and got[7:] == texts[7:]
    assert got[1] == "a title\nan end" and rows[1]["n_removed"] == 20
    assert got[3] == "\u6807\u9898\n" and got[5] == "head\n\ntail"
    assert got[6] == "la la la\n" * 3 and rows[6]["n_removed"] == 17


def test_texts_between_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.where("doc_id % 4 <> 2")
    dictionaries, margins = language_id.fit_dictionaries(learn), language_id.fit_margin(learn)
    assert margins > language_id.MARGIN
    r, clean = random.Random(1), docs.where("doc_id % 4 = 2 and lang is not null and octet_length(text) >= 60").toPandas()
    by_lang = {lang: list(own["text"]) for lang, own in clean.groupby("lang")}
    rows = [(f"clean {'short' if len(t.encode()) < 400 else 'long'}", t) for t in clean["text"]]
    for n in (300, 1600, 6000):
        rows += [(f"foreign {n}", "".join(r.choice(letters + "     ") for _ in range(n))) for letters in ("abcdefghijklmnopqrstuvwxyz", "abdeghiklmnoprstu", "αβγδεζηθικλμνξοπρστυφχψω") for _ in range(30)]
    for n in (150, 3000):
        for _ in range(100):
            a, b = ("\n".join(r.sample(by_lang[lang], 5)) for lang in r.sample(sorted(by_lang), 2))
            rows.append((f"mixed {n}", a[: n // 2] + " " + b[: n // 2]))
    got = collections.defaultdict(list)
    for x in language_id.classify(spark.createDataFrame(rows, "kind string, text string"), dictionaries, margins).collect():
        got[x["kind"]].append(x["rejected"])
    share = {kind: sum(own) / len(own) for kind, own in got.items()}
    print(margins, share)
    assert share["clean long"] <= 0.05 and share["clean short"] <= 0.2
    assert all(share[f"foreign {n}"] >= 0.9 for n in (300, 1600, 6000)) and all(share[f"mixed {n}"] >= 0.25 for n in (150, 3000))


def test_encoder_uses_second_order_predictors_where_they_are_shorter():
    ramp = bytes((128 + int(90 * np.sin(i / 40))) & 255 for i in range(20000))
    stream, lower = flac.encode_many([ramp])[0], flac.encode_many([ramp], most_order=1)[0]
    assert len(stream) < len(lower) and stream == flac.encode_many([ramp], most_order=4)[0]
    assert [bytes((x + 128) & 255 for x in own.tolist()) for own in flac.decode_many([stream, lower])] == [ramp, ramp]


def test_estimates_and_verdicts_equal_an_exact_search(spark):
    """A plain numpy MCD (the best of many random starts) on the same features gives nearly the same distances and verdicts."""
    r = random.Random(4)
    vocabulary = [word() for _ in range(300)]
    clean = lambda: " ".join(r.choice(vocabulary) + r.choice(["", "", ".", ","]) + (" The" if r.random() < 0.1 else "") for _ in range(r.randint(30, 300)))
    junk = lambda: " ".join(f"#$%&{r.randint(1, 10**9)}|<>*#" for _ in range(r.randint(50, 200)))
    rows = [(i, junk() if i % 20 == 7 else clean(), "a", "x") for i in range(600)]
    counts = quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).drop("text")
    estimates = quality.fit_cells(counts, prior=0.0)
    got = {x["doc_id"]: x for x in quality.judge(counts, estimates).collect()}
    table = counts.select("*", *quality._cell()).join(quality.rates(counts), "cell_lang").select("doc_id", *(f.alias(f"f{i}") for i, f in enumerate(quality.features()))).toPandas()
    x, rng, h, best = table[[f"f{i}" for i in range(quality.D)]].to_numpy(), np.random.default_rng(1), int(0.75 * 600), None
    for _ in range(60):
        own = rng.choice(600, 60, replace=False)
        for _ in range(15):
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True)
            cov += np.diag(np.maximum(0, np.array(quality.FLOOR) ** 2 - np.diag(cov)) + 1e-9)
            d2 = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            own = np.argsort(d2)[:h]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, d2
    want = best[1] / np.median(best[1]) * quality.CHI_SQUARE[1]
    mine = np.array([got[i]["distance"] for i in table["doc_id"]])
    assert np.corrcoef(np.log(want), np.log(mine))[0, 1] > 0.98
    assert abs(estimates.first()["log_det"] - best[0]) < 0.3
    kept = np.array([got[i]["kept"] for i in table["doc_id"]])
    assert not kept[table["doc_id"] % 20 == 7].any() and kept[table["doc_id"] % 20 != 7].mean() > 0.97


def test_small_cells_are_judged_by_their_language_and_few_rows_at_all(spark):
    r = random.Random(4)
    clean = lambda lang: " ".join(r.choice(["amet", "dolor", "ipsum", "lorem", "sit"] if lang == "a" else ["incomprehensible", "characterisation", "responsibilities"]) + str(r.randint(1, 10**6)) for _ in range(r.randint(80, 120)))
    junk = " ".join(f"#$%&{r.randint(1, 10**9)}|<>*#" for _ in range(100))
    rows = [(i, clean(lang), lang, source) for i, (lang, source) in enumerate([("a", "x")] * 60 + [("b", "y")] * 60 + [("b", "z")] * 5)]
    rows += [(200, junk, "b", "z")]
    schema = "doc_id long, text string, lang string, source string"

    def judged(rows):
        counts = quality.with_counts(spark.createDataFrame(rows, schema))
        return {x["doc_id"]: x for x in quality.judge(counts, quality.fit_cells(counts)).collect()}

    got = judged(rows)
    assert not got[200]["kept"] and all(x["distance"] is not None for x in got.values())
    assert sum(got[i]["kept"] for i in range(125)) >= 118
    few = judged(rows[:30] + rows[-1:])
    assert sum(few[i]["kept"] for i in range(30)) >= 27


def test_a_language_is_that_of_the_smallest_sizes(spark):
    """Predictions equal those of a plain loop over whole-dictionary sizes, with ties by the parts; clashing columns stay."""
    import zstandard as zstd

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.lit("mine").alias("score"), F.lit(1).alias("GAP"))
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "\n \t"), (903, "x " * 60_000), (904, "1234 !"), (900, None)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    dictionaries = language_id.fit_dictionaries(docs)
    assert set(dictionaries) == {r["lang"] for r in docs.where("lang is not null and text rlike '[a-z]'").select("lang").distinct().collect()}

    def size(data, text):
        content = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        raw, total = text.lower().encode(), 0
        for i in range(0, len(raw), 2048):
            content.precompute_compress(level=9)
            total += len(zstd.ZstdCompressor(dict_data=content, level=9, write_content_size=False, write_dict_id=False).compress(raw[i : i + 2048]))
        return total

    out = language_id.classify(docs, dictionaries, 0.02)
    assert [c for c in out.columns] == ["doc_id", "text", "lang", "own_score", "GAP", "lang_pred", "score", "rejected"]
    n = 0
    for r in out.collect():
        if not r["text"] or not re.search("[a-zA-Z]", r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        sizes = sorted((size(data, r["text"]), lang) for lang, data in dictionaries.items())
        gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert abs(r["score"] - gap / (gap + 0.02)) < 1e-9 and r["rejected"] == (gap < 0.02)
        if gap:
            assert r["lang_pred"] == sizes[0][1]
            n += 1
    assert n > 100


def test_of_equal_or_null_ids_one_keeps_its_unit(spark):
    line = "one line of more than eight words that several documents have in common"
    rows = [(None, line + "\nfirst"), (None, line + "\nsecond"), (None, line + "\nthird"), (4, "x " * 9 + "\n" + line + " also"), (4, line + " also\nbut not the same text")]
    rows += [(i, "a line that very many documents share with one another here\nown words of " + str(i)) for i in range(10, 400)]
    docs = spark.createDataFrame([(*r, "user's") for r in rows], "doc_id long, text string, N_Removed string")
    out = substrings.remove_repeats(docs).collect()
    assert sorted(line in r["text"].split("\n") for r in out if r["doc_id"] is None) == [False, False, True]
    assert sum((line + " also") in r["text"] for r in out if r["doc_id"] == 4) == 1
    assert [r["doc_id"] for r in out if "very many" in r["text"]] == [10] and all(r["own_N_Removed"] == "user's" for r in out)


def test_tables_of_integers_hold_what_was_put():
    rng, table, held = np.random.default_rng(1), bpe_automaton.IntTable(4), {}
    for size in (1, 10, 300, 5000, 20):
        keys = np.setdiff1d(rng.integers(0, 2**62, size), np.array(list(held), np.int64))
        table.put(keys, np.arange(len(keys)) + len(held))
        held.update(zip(keys.tolist(), range(len(held), len(held) + len(keys))))
        asked = np.concatenate([np.array(list(held), np.int64), rng.integers(0, 2**62, 50)])
        assert table.get(asked).tolist() == [held.get(k, -1) for k in asked.tolist()]
    assert table.get(np.zeros(0, np.int64)).tolist() == []


def test_chunks_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = byte_tokens.default_path("byte_bpe_50k.json")
    t, r = Tokenizer.from_file(path), random.Random(5)
    pieces = ["the", " ", "  ", "\n", "\t", "it's", "Ünï", "\u3000", "\xa0", "\x1c", "<|endoftext|>", "12", "!?", "\0", "\U0001f600", "a" * 300, "\r\n", "'ll"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for most in (900_000, 50):
        own = byte_tokens.ChunkCoder(path, most)
        for at in range(0, len(texts), 100):
            ids, counts = own.encode(texts[at : at + 100])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts[at : at + 100]]


def test_words_are_encoded_as_they_stand_after_a_blank(spark):
    path = byte_tokens.default_path("byte_bpe_50k.json")
    r = random.Random(6)
    letters = ["a", "B", "é", "\xa0", "\u3000", "\x1d", "'s", "9", "<|endoftext|>", "\U0001f600", "\0"]
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(800)]
    own = lm_scoring.WordIds(path)
    import pyarrow as pa

    for at in (0, 400, 0):
        data, offsets = lm_scoring.text_bytes(pa.array([" ".join(words[at : at + 400])]))
        start, end, _ = lm_scoring.word_spans(data, offsets)
        ids, size = own.ids_of(own.entries(data, start, end))
        want = [own.coder.ranked.encode_ordinary(" " + w.encode().lower().decode()) for w in words[at : at + 400]]
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want
        assert np.flatnonzero(own.begins[ids]).tolist() == (np.cumsum(size) - size).tolist()


def test_slots_of_a_row_that_comes_very_often(spark):
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 90).alias("text")))
    out = sharding.shard_documents(rows, 5).cache()
    assert out.count() == 100_500 and out.select("shard", "slot").distinct().count() == 100_500
    assert all(r["low"] == 0 and r["high"] == r["n"] - 1 for r in out.groupBy("shard").agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.count("*").alias("n")).collect())
    assert out.where("doc_id is null").select("shard").distinct().count() == 1
    # no window sees more than its bucket: equal rows are dealt to many
    few = spark.createDataFrame([(0, "a", 0, 0, 7_001), (0, "b", 0, 0, 1), (1, "c", 0, 0, 3)], "shard int, doc_id string, text_crc32 long, size long, times long")
    slots = sharding.number_slots(few, ["doc_id", "text_crc32", "size"], per_bucket=100, chunk=10).collect()
    assert sorted((r["shard"], r["slot"]) for r in slots) == [(0, i) for i in range(7_002)] + [(1, i) for i in range(3)]
    assert collections.Counter(r["doc_id"] for r in slots) == {"a": 7_001, "b": 1, "c": 3}


def test_tiles_meet_each_pair_once(spark):
    rng = random.Random(5)
    rows = [(b, c, rng.choice([1, 4, 5, 79, 80, 100, 125, 126, 1000])) for b in range(3) for c in range(60 if b else 400)]
    one, two = near_duplicates.tiles(spark.createDataFrame(rows, "bucket long, class_id long, n int"), 80, block=50)
    two = two.select("bucket", "tile", F.col("class_id").alias("other"), F.col("n").alias("m"))
    met = one.join(two, ["bucket", "tile"]).where("100 * least(n, m) >= 80 * greatest(n, m)")
    got = collections.Counter((r["bucket"], r["class_id"], r["other"]) for r in met.collect())
    want = {(b, c, d) for b, c, n in rows for e, d, m in rows if b == e and 100 * min(n, m) >= 80 * max(n, m)}
    assert set(got) == want and set(got.values()) == {1}
    assert one.groupBy("bucket", "tile").count().agg(F.max("count")).first()[0] <= 80


def test_near_duplicates_with_a_hot_bucket_and_shingle(spark, monkeypatch):
    """Thousands of documents in one bucket with one common passage, every join salted and every bucket tiled."""
    monkeypatch.setattr(common, "SMALL_ROWS", 10)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = list(base)
        for j in rng.sample(range(60), rng.choice([0, 1, 2, 5, 9])):
            own[j] = f"v{rng.randrange(12)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(1500)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    sets = {t: {tuple(t.split()[i : i + 2]) for i in range(59)} for _, t in rows}
    distinct, parent = list(sets), {}
    first = {}
    for i, t in rows:
        first[t] = min(first.get(t, i), i)
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in itertools.combinations(distinct, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for t in distinct:
        least[find(t)] = min(least.get(find(t), 1 << 60), first[t])
    assert got == {i: least[find(t)] for i, t in rows}
    assert len(set(got.values())) > 20
