"""Byte-level BPE by prefix-sharing traversal.

The encoding of a word is fixed by one state per prefix: the last token of that
prefix's own encoding. A token fits after a prefix exactly if the two neighbouring
tokens, put side by side, are not merged across their border; only one token fits.
Sorted distinct words are the order of their trie: a node belongs to the first word that
has its prefix, so the states of shared prefixes are computed once and passed on to the words
below. All nodes of a depth are computed together, from the root down: an automaton of the
vocabulary names the tokens that a prefix may end with, longest first, and the state where each would
begin decides whether it fits. What a task keeps is bounded: caches are replaced or emptied
when they reach their limit, which costs time and changes no result.

Texts are cut into pieces before single spaces first, where no token can cross, so the
pattern of the pre-tokenizer only runs on pieces not seen before. Texts with a
space after other white space take the pattern as a whole.

A null text counts as empty and has no tokens, a null doc_id stays null, repeated rows
get equal results, other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_schema, id_text, public_id

PIECES_KEPT = 60_000  # of each generation of the cache from pieces to ids
PAIR_BITS = 20  # of the places for pairs of neighbouring tokens
LONGEST = 64  # bytes of a word that goes by levels; longer ones go alone
CELLS = 1_000_000  # bytes of the words whose levels are worked on together
NEVER = (1 << 31) - 1
SPREAD = np.uint64(0x9E3779B97F4A7C15)

# The pattern of the byte-level pre-tokenizer; the order of alternatives
# that start with different characters is free.
WORDS = regex.compile(r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CROSSING = [c + " " for c in map(chr, range(0x3001)) if regex.match(r"\s", c)]


@cache
def byte_letters() -> dict[str, int]:
    """The printable character that the vocabulary file writes for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def to_bytes(token: str) -> bytes:
    return bytes(map(byte_letters().__getitem__, token))


def specification(path: str) -> tuple[dict, dict[str, int]]:
    """The vocabulary file, and its special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return spec, {x["content"]: x["id"] for x in spec.get("added_tokens", [])}


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    """What each id decodes to."""
    spec, special = specification(path)
    plain = {i: to_bytes(t) for t, i in spec["model"]["vocab"].items() if t not in special}
    return plain | {i: t.encode() for t, i in special.items()}


class Automaton:
    """The tokens as an Aho-Corasick automaton: which tokens a prefix ends with, longest first."""

    def __init__(self, ids: dict[bytes, int], n: int):
        children: list[dict[int, int]] = [{}]
        parents, letters, depths, token = [0], [0], [0], [-1]
        for word, i in ids.items():
            node = 0
            for byte in word:
                child = children[node].get(byte)
                if child is None:
                    child = children[node][byte] = len(parents)
                    children.append({})
                    parents.append(node)
                    letters.append(byte)
                    depths.append(depths[node] + 1)
                    token.append(-1)
                node = child
            token[node] = i
        parent, letter, depth = np.array(parents), np.array(letters), np.array(depths)
        leaf = np.array([not c for c in children])
        self.row = np.where(leaf, 0, np.cumsum(~leaf) - 1).astype(np.int32)  # a leaf steps as the state it falls back to
        self.step = np.zeros((int((~leaf).sum()), 256), np.int32)  # row of a state, byte -> state
        self.longest = np.array(token, np.int32)  # state -> the longest token it ends with
        self.shorter = np.full(n, -1, np.int32)  # token -> the longest token that it ends with itself
        fail = np.zeros(len(parents), np.int32)
        for d in range(depth.max() + 1):
            here = np.flatnonzero(depth == d)
            if d > 1:
                fail[here] = self.step[self.row[fail[parent[here]]], letter[here]]
            if d:
                back = self.row[fail[here]]
                self.row[here] = np.where(leaf[here], back, self.row[here])
                inner = ~leaf[here]
                self.step[self.row[here[inner]]] = self.step[back[inner]]
                ends = self.longest[fail[here]]
                own = self.longest[here] >= 0
                self.shorter[self.longest[here[own]]] = ends[own]
                self.longest[here[~own]] = ends[~own]
            below = np.flatnonzero(depth == d + 1)
            self.step[self.row[parent[below]], letter[below]] = below


class Vocabulary:
    """Tokens, merges and the test whether two tokens can be neighbours."""

    def __init__(self, path: str):
        spec, self.special = specification(path)
        ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.tokens = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        n = max(ids.values()) + 1
        self.length = np.zeros(n, np.int64)
        self.length[list(ids.values())] = list(map(len, ids))
        self.automaton = Automaton(ids, n)
        merges: dict[int, int] = {}  # pair -> rank
        made: dict[int, tuple[int, int, int]] = {}  # token -> its rank and halves
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(to_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            merges.setdefault(ids[left] << 32 | ids[right], rank)
            made.setdefault(ids[left + right], (rank, ids[left], ids[right]))
        self.pairs = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[p] for p in self.pairs.tolist()], np.int32)
        self.left, self.right = self._spines(made, n, 2), self._spines(made, n, 1)
        self.known = np.full(1 << PAIR_BITS, -1, np.int64)  # pairs tested lately, each at a place of its own hash
        self.fit = np.zeros(1 << PAIR_BITS, bool)

    @staticmethod
    def _spines(made: dict[int, tuple[int, int, int]], n: int, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token, the tokens at one border as they form, single byte first, and the rank that ends each."""
        spines = {}
        for token in range(n):
            spine, part = [], token
            while part in made:
                spine.append((made[part][0], part))
                part = made[part][side]
            spines[token] = [*reversed([*spine, (-1, part)]), (NEVER, -1)]
        width = max(map(len, spines.values()))
        ranks, tokens = np.full((n, width), NEVER, np.int32), np.full((n, width), -1, np.int32)
        for token, spine in spines.items():
            ranks[token, : len(spine)], tokens[token, : len(spine)] = zip(*spine)
        return ranks, tokens

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``a`` then ``b`` stay apart when their bytes are encoded together."""
        (left_ranks, left), (right_ranks, right) = self.left, self.right
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(at):
            x, y = a[at], b[at]
            grow_left, grow_right = left_ranks[x, i + 1], right_ranks[y, j + 1]
            pair = left[x, i].astype(np.int64) << 32 | right[y, j]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = np.where(self.pairs[place] == pair, self.ranks[place], NEVER)
            # Equal ranks are applied from the left.
            merged = (joined < grow_left) & (joined <= grow_right)
            out[at[merged]] = False
            go = ~merged & ((grow_left != NEVER) | (grow_right != NEVER))
            first = grow_left <= grow_right
            at, i, j = at[go], (i + first)[go], (j + ~first)[go]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``neighbours``, remembered for the pairs met lately."""
        pair = a.astype(np.int64) << 32 | b
        place = (pair.astype(np.uint64) * SPREAD >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fit[place]
        new = np.flatnonzero(self.known[place] != pair)
        if len(new):
            once, back = np.unique(pair[new], return_inverse=True)
            fit = self.neighbours(once >> 32, once & 0xFFFFFFFF)[back]
            out[new] = fit
            # Of pairs that want one place the last stays, with its own answer.
            order = np.argsort(place[new], kind="stable")
            places = place[new][order]
            last = order[np.r_[places[1:] != places[:-1], True]]
            self.known[place[new[last]]], self.fit[place[new[last]]] = pair[new[last]], fit[last]
        return out

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words, as the bytes of int32 arrays."""
        out: dict[bytes, bytes] = {}
        classes: dict[int, list[bytes]] = {}
        for word in words:
            size = len(word)
            classes.setdefault(0 if size > LONGEST else 16 if size <= 16 else LONGEST, []).append(word)
        for word in classes.pop(0, ()):
            out[word] = self._encode_long(word)
        for width, alike in classes.items():
            alike.sort()
            for lo in range(0, len(alike), CELLS // width):
                self._encode_sorted(alike[lo : lo + CELLS // width], out)
        return out

    def _encode_sorted(self, words: list[bytes], out: dict[bytes, bytes]) -> None:
        """Level by level of the trie of sorted words: a node is computed in the first word that has it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        letters = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        differ = letters[1:] != letters[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared = np.r_[0, np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))]
        lasts = np.full((width + 1, len(words)), -1, np.int32)  # depth, word -> last token of the prefix
        state = np.zeros(len(words), np.int32)
        index, length, row, step = np.arange(len(words)), self.length, self.automaton.row, self.automaton.step
        for depth in range(1, width + 1):
            new = shared < depth
            owner = np.maximum.accumulate(np.where(new, index, 0))
            rows = np.flatnonzero(new & (sizes >= depth))
            state[rows] = step[row[state[rows]], letters[rows, depth - 1]]
            token = self.automaton.longest[state[rows]]
            open_ = np.flatnonzero(length[token] < depth)
            while len(open_):
                tried = token[open_]
                fit = self.fits(lasts[depth - length[tried], rows[open_]], tried)
                open_, tried = open_[~fit], tried[~fit]
                token[open_] = self.automaton.shorter[tried]
            lasts[depth, rows] = token
            lasts[depth], state = lasts[depth, owner], state[owner]
        ends, steps = sizes.copy(), []
        rows = index
        while len(rows):
            token = lasts[ends[rows], rows]
            steps.append((rows, token))
            ends[rows] -= length[token]
            rows = rows[ends[rows] > 0]
        counts = np.zeros(len(words), np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        stops = np.cumsum(counts)
        ids = np.empty(int(stops[-1]), np.int32)
        for k, (rows, token) in enumerate(steps):
            ids[stops[rows] - 1 - k] = token
        raw, stop = ids.tobytes(), (4 * stops).tolist()
        out.update((w, raw[a:b]) for w, a, b in zip(words, [0, *stop], stop))

    def _encode_long(self, word: bytes) -> bytes:
        """One word by itself, byte by byte."""
        row, step, length = self.automaton.row, self.automaton.step, self.length
        longest, shorter = self.automaton.longest, self.automaton.shorter
        lasts, state, tested = [-1], 0, {}
        for end, byte in enumerate(word, 1):
            state = step[row[state], byte]
            token = int(longest[state])
            while (start := end - int(length[token])) > 0:
                pair = lasts[start], token
                if pair not in tested:
                    tested[pair] = bool(self.neighbours(np.array([pair[0]]), np.array([token]))[0])
                if tested[pair]:
                    break
                token = int(shorter[token])
            lasts.append(token)
        found, end = [], len(word)
        while end:
            found.append(lasts[end])
            end -= int(length[lasts[end]])
        return np.array(found[::-1], np.int32).tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def _pre_tokenizer():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False)


def words_of(text: str) -> list[str]:
    """The words of a text as the pre-tokenizer cuts them."""
    if text.isascii() or "Cn" not in set(map(unicodedata.category, set(text))):
        return WORDS.findall(text)
    # Tables of different Unicode versions disagree here, so the library has the say.
    return [text[i:j] for _, (i, j) in _pre_tokenizer().pre_tokenize_str(text)]


def cut_pieces(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all pieces, one after the other, and how many each has. Every piece starts with a space."""
    joined = "".join(pieces)
    if not joined.isascii() and "Cn" in set(map(unicodedata.category, set(joined))):
        words = list(map(words_of, pieces))
        return [w for x in words for w in x], np.fromiter(map(len, words), np.int64, len(words))
    # No word goes on beyond a piece, since the next one starts with a space.
    words = WORDS.findall(joined)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))) + 1
    return words, np.diff(last, prepend=0)


class Encoder:
    """Encodes batches of texts; keeps pieces between batches up to a limit."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # a full cache becomes the older one, whose entries come back on use
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _words(self, text: str) -> list[str]:
        """Words and special tokens of a text that can't be cut at every space."""
        if not any(map(text.__contains__, self.vocabulary.special)):
            return words_of(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if part:
                out += [part] if i % 2 else words_of(part)
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, as the bytes of int32 arrays."""
        found, new = {}, []
        get, older, special = self.pieces.get, self.older.get, self.vocabulary.special
        for p in pieces:
            ids = get(p) or older(p)
            if ids is None:
                new.append(p)
            else:
                found[p] = ids
        for p in [p for p in new if p in special]:
            found[p] = np.array([special[p]], np.int32).tobytes()
        spaced = [p for p in new if p[0] == " " and p not in special]
        rest = [p for p in new if p[0] != " " and p not in special]
        words, counts = cut_pieces(spaced)
        cut = list(map(words_of, rest))
        every = {w: w.encode() for w in words}
        every.update((w, w.encode()) for x in cut for w in x)
        ids = self.vocabulary.encode_words(every.values())
        end = 0
        for p, n in zip(spaced, counts.tolist()):
            found[p] = ids[every[words[end]]] if n == 1 else b"".join([ids[every[w]] for w in words[end : end + n]])
            end += n
        found.update((p, b"".join([ids[every[w]] for w in x])) for p, x in zip(rest, cut))
        if len(self.pieces) + len(found) > PIECES_KEPT:
            self.older, self.pieces = self.pieces, {}
        if len(found) <= PIECES_KEPT:
            self.pieces.update(found)
        else:
            self.pieces = dict(islice(found.items(), PIECES_KEPT))
        return list(map(found.__getitem__, pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins (one more than texts)."""
        plain = texts.to_pylist()
        crossing = [*CROSSING, *self.vocabulary.special]
        odd = {i: self._words(t) for i, t in enumerate(plain) if any(map(t.__contains__, crossing))}
        for i in odd:
            plain[i] = ""
        # Each text becomes its pieces: what comes before the first space, then space and word again and again.
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        begins = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        # Pieces that don't start with that space have numbers of their own.
        number = {p: i for i, p in enumerate({distinct[c] for c in codes[begins[:-1]].tolist()}.union(*odd.values()), len(distinct))}
        codes[begins[:-1]] = [number[distinct[c]] for c in codes[begins[:-1]].tolist()]
        parts, last, counts = [], 0, np.diff(begins)
        for i, words in odd.items():
            parts += [codes[last : begins[i]], np.array([number[w] for w in words], np.int64)]
            last, counts[i] = begins[i + 1], len(words)
        codes = np.concatenate([*parts, codes[last:]])
        pieces = [" " + x for x in distinct] + list(number)
        once = {p: None for p in pieces if p}
        ids = dict(zip(once, self._encode_pieces(list(once))))
        ids[""] = b""
        found = [ids[p] for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        values = np.frombuffer(b"".join(found), np.int32)
        size = sizes[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        gathered = values[np.repeat(starts[codes] - ends + size, size) + np.arange(total)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return gathered, bounds


@cache
def encoder(path: str) -> Encoder:
    """One a worker process, so that later tasks find its caches."""
    return Encoder(path)


def _types(frame: DataFrame, names: Sequence[str]) -> str:
    return "".join(f", {n} {frame.schema[n].dataType.simpleString()}" for n in names)


def _texts(get: Callable[[int], bytes], values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """What runs of ids decode to."""
    ends = bounds.tolist()
    return pa.array(
        [b"".join(map(get, values[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string()
    )


def encode(
    docs: DataFrame, path: str, batch: int = 1000, carried: Sequence[str] = (), decoded: bool = False
) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and the columns ``carried``, one row per row of ``docs``.

    With ``decoded`` the column of that name holds what the ids decode to, from the same worker: the
    rows of ``decode`` without sending all ids to a second one.
    """
    extra = ", decoded string" if decoded else ""
    schema = f"did long, ids array<int>{extra}{_types(docs, carried)}"
    target = arrow_schema(docs.sparkSession, schema)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, get = encoder(path).encode, encoder(path).vocabulary.tokens.__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                values, bounds = run(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))
                texts = [_texts(get, values, bounds)] if decoded else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists.cast(target.field(1).type), *texts, *part.columns[2:]], schema=target
                )

    names = ["ids", "decoded"] if decoded else ["ids"]
    return id_text(docs, *carried).mapInArrow(task, schema).select(public_id(), *names, *carried)


def decode(encoded: DataFrame, path: str, carried: Sequence[str] = (), batch: int = 1000) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids``; bytes that are not UTF-8 become U+FFFD."""
    schema = f"doc_id long, ids array<int>, decoded string{_types(encoded, carried)}"
    target = arrow_schema(encoded.sparkSession, schema)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = token_bytes(path).__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                lists = part.column(1)
                texts = _texts(get, lists.values.to_numpy(), lists.offsets.to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts, *part.columns[2:]], schema=target)

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids, *carried).mapInArrow(task, schema)


def summary(decoded: DataFrame, *columns: str) -> DataFrame:
    """Counts and digests of ``decode``'s rows, after ``columns`` of theirs."""
    return decoded.select(
        "doc_id",
        *columns,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
