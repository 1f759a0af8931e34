"""Prefix trie, packing and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.rows import odd_rows, plain
from tokenizers import Tokenizer

from skein.llm import packing, periods, prefixes
from skein.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = r"[^\x20\x09-\x0D]+"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# --- conversation prefixes ---


def nulls_first(x):
    return x is not None, 0 if x is None else x


def trie_rows(rows, planted=True):
    """Nodes by the definition, from all prefixes of all conversations."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: nulls_first(r[1])):
        own[c].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if planted and c is not None else 0
        base = c - int(math.fmod(c, 20)) if h else None  # as SQL divides
        built[c] = (own[base][:h] if h and base in own else []) + turns[h:]
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        words = (len(convs) - 1) * len(re.findall(WORD, path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += words
            leaves[path[:d]] += not children[path]
    out = []
    for path, convs in members.items():
        least = min(convs, key=nulls_first)
        parent = min(members[path[:-1]], key=nulls_first) if path else None
        end = sorted((c for c in convs if len(built[c]) == len(path)), key=nulls_first)
        digest = sha(",".join("" if c is None else str(c) for c in end))
        out.append((least, len(path), parent, len(convs), children[path], leaves[path], saved[path], digest))
    return plain(out)


def trie_of(frame, heads=prefixes.planted):
    return plain(prefixes.summary(*prefixes.trie(frame, heads)).collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string, ka long, m long, at long, t0 string, depth long"


def conversation_frame(spark, rows):
    return spark.createDataFrame([(*r, None, 7, 8, "x", 9) for r in rows], CONVERSATIONS).repartition(3)


def test_trie_query(spark, sf):
    rows = [tuple(r) for r in prefixes.conversations(spark, sf).select("conv_id", "turn", "role", "text").collect()]
    assert plain(QUERIES["op11_prefix_trie"](spark, sf).collect()) == trie_rows(rows)


def test_trie_of_long_alike_and_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SLICE", 3)
    monkeypatch.setattr(prefixes, "CHUNK", 40)
    rng, rows = random.Random(3), []
    for c in range(120):  # a few distinct turns, so that prefixes are shared; copies; lengths around the block's
        n = rng.choice([1, 2, 7, 8, 9, 16, 17, 60])
        rows += [(c, t, rng.choice("ua"), "x y"[: rng.choice([1, 3])] if t < 20 else "same") for t in range(n)]
    rows += [(c, t, "u", f"copy {t}") for c in range(200, 260) for t in range(8)]
    rows += [(300, t, "u", f"one {t % 2}") for t in range(400)]  # one conversation with much of the table
    rows += [(None, 3, "u", "later"), (None, None, None, None), (None, 1, "a", " \t two words\x0b"), (-3, 0, None, "neg")]
    rows += [(301, None, "u", "null turn"), (301, 0, "", "zero"), (303, -5, "u", "minus"), (303, 5, "u", "")]
    assert trie_of(conversation_frame(spark, rows)) == trie_rows(rows)
    assert trie_of(conversation_frame(spark, rows), prefixes.no_heads) == trie_rows(rows, planted=False)


def test_trie_of_repeated_rows_and_no_rows(spark):
    rows = [(1, 0, "u", "again")] * 40 + [(2, 0, "u", "again")] * 3 + [(40, 1, "u", "b"), (40, 1, "u", "b")]
    assert trie_of(conversation_frame(spark, rows)) == trie_rows(rows)
    ties = [(1, 0, "u", "b"), (1, 0, "u", "a"), (1, 0, "a", "c")]
    first, second = (trie_of(conversation_frame(spark, x), prefixes.no_heads) for x in (ties, ties[::-1]))
    assert first == second and len(first) == 4
    assert trie_of(conversation_frame(spark, rows).where("1 = 0")) == []


# --- packing ---


def expected_pieces(rows):
    library, out = Tokenizer.from_file(BPE), []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        end, start, piece = (len(ids) - 1) % 2048 + 1, 0, 0
        while start < len(ids):
            out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, piece = end, end + 2048, piece + 1
    return plain(out)


def sequences(rows):
    """Checks that places are gapless; the sequences with their fills."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return {s: sum(n for _, n in p) for s, p in places.items()}


@pytest.mark.parametrize("node, fan", [(1 << 14, 16), (12, 2), (30, 3)])
def test_packing(monkeypatch, docs, texts, odd, none, node, fan):
    monkeypatch.setattr(packing, "NODE", node)
    monkeypatch.setattr(packing, "FAN", fan)
    for frame, rows in ((docs, texts), (odd, odd_rows())):
        got = packing.pack(frame, BPE).collect()
        assert plain(tuple(r)[:5] for r in got) == expected_pieces(rows)
        fills = sequences(got)
        least = -(-sum(fills.values()) // packing.CAPACITY)
        whole = packing.best_fit(np.array([r.length for r in got]))[2]
        assert len(fills) <= len(whole) + (1 if node > 1000 else 1 + least // 10)
    assert packing.pack(none, BPE).collect() == []


def test_small_bins_of_other_nodes_fill_up_large_ones(spark, monkeypatch):
    monkeypatch.setattr(packing, "NODE", 8)
    monkeypatch.setattr(packing, "FAN", 4)
    rng = random.Random(2)
    sizes = [rng.choice([1500, 1500, 1200, 40, 60]) for _ in range(300)]
    rows = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES)
    monkeypatch.setattr(packing, "pieces", lambda docs, path: rows)
    fills = sequences(packing.pack(None, "").collect())
    assert sum(fills.values()) == sum(sizes)
    assert sum(f <= packing.CAPACITY // 2 for f in fills.values()) <= 1
    assert len(fills) <= sum(n > 1024 for n in sizes) + 2


def test_best_fit_takes_the_fullest_bin_with_room():
    bins, offsets, fills = packing.best_fit(np.array([1000, 900, 1100, 40, 2048, 1048]))
    assert fills.tolist() == [2048, 2048, 2040] or sorted(fills.tolist()) == [2040, 2048, 2048]
    for b in range(len(fills)):
        assert sum(s for s, x in zip([1000, 900, 1100, 40, 2048, 1048], bins) if x == b) == fills[b]


def test_ids_of_odd_texts_are_the_library_s():
    library, mine, rng = Tokenizer.from_file(BPE), packing.Encoder(BPE), random.Random(1)
    letters = [*"aeiou bcdt  \n\t'sreé1 2.,!ß€漢😀", "<|endoftext|>", "՘", "​", " ", " ", "\x1c", "\x00", "᠎", "\x85", "ⁿ", "Ა"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a" * 30_000, "don't we'll 'S", "  x", "x  ", " " * 5000 + "x", "-" * 26, "a b " * 400 + "\n " * 600 + "c"]
    assert packing._long_stretch(texts[-1]) and not packing._long_stretch("a  b " * 1000)
    for text in texts:
        assert mine.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


# --- periodic runs ---


def runs_by_definition(words):
    """Maximal stretches of every lag; the smallest lag of equal stretches is their period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(12, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed_row(doc_id, text, planted):
    words = re.findall(WORD, text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(runs_by_definition(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *first, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(docs, texts, none):
    short = [(i, t) for i, t in texts if len(t) < 8000]
    got = {r.doc_id: tuple(r) for r in periods.summary(periods.collapse(docs, periods.planted)).collect()}
    assert len(got) == len(texts) and sum(r[1] > 0 for r in got.values()) > 10
    assert [got[i] for i, _ in short] == [collapsed_row(i, t, True) for i, t in short]
    assert periods.collapse(none).collect() == []


def test_periodic_runs_of_odd_rows(odd):
    rows = [(i, t) for i, t in odd_rows() if len(t or "") < 20_000]
    got = Counter(tuple(r) for r in periods.summary(periods.collapse(odd)).collect())
    want = Counter(collapsed_row(i, t, False) for i, t in rows)
    assert not want - got and sum(got.values()) == len(odd_rows())
    (long,) = got - want
    assert long[0] == 11


def periodic_texts():
    rng = random.Random(8)
    a, b = [0], [0, 1]
    while len(b) < 150:
        a, b = b, b + a
    yield b
    thue = [bin(i).count("1") % 2 for i in range(256)]
    yield from (thue, thue + thue[:100], [0] * 200, [0] * 11, [0] * 12, [])
    for _ in range(400):
        kind = rng.randrange(4)
        if kind == 0:
            yield rng.choices(range(rng.choice([2, 3])), k=rng.randrange(130))
        elif kind == 1:
            part = rng.choices(range(5), k=rng.randrange(1, 50))
            out = (part * 6)[: rng.randrange(len(part) * 6 + 1)]
            for _ in range(rng.randrange(3)):
                if out:
                    out[rng.randrange(len(out))] = 9
            yield out
        else:
            out = []
            while len(out) < 120:
                out += rng.choices(range(4), k=rng.randrange(1, 20)) * rng.randrange(1, 5)
            yield out


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_runs_equal_the_definition(monkeypatch, block):
    monkeypatch.setattr(periods, "PAIRS", block)
    words = list(periodic_texts())
    for lo in range(0, len(words), 9):
        part = words[lo : lo + 9]
        got = periods.runs_of([np.array(x, np.int64) for x in part])
        assert [[tuple(r) for r in got.get(i, np.zeros((0, 3), int)).tolist()] for i in range(len(part))] == [
            sorted(runs_by_definition(x), key=lambda r: (r[0], r[2])) for x in part
        ]


def test_repetitive_texts_cost_little():
    (runs,) = periods.runs_of([np.zeros(100_000, np.int64)]).values()
    assert runs.tolist() == [[0, 100_000, 1]]
    place, _ = next(periods.pairs(np.zeros(5000, np.int64), 6, 12, 23))
    assert len(place) <= 2 * 5000
