"""Periodic runs of words by seeds on diagonals: stretches that repeat with a fixed lag.

A run is a stretch of consecutive words with smallest period q, of at least LEAST words and
two periods, that no neighbouring word extends. On the diagonal of lag q, where word i meets word
i + q, it is a segment of at least max(q, LEAST - q) equal words. Lags are taken in
bands: the first holds those below LEAST, each further band goes up to twice its smallest lag. A
band has a guaranteed overlap, so its runs contain an equal pair of k-grams:

1. The first band indexes all grams of SEED words. A band from lag m on indexes grams of m / 2 words, and
   of every segment one gram starts at a multiple of m / 2; only those look for a partner.
2. Occurrence pairs of one gram are enumerated within the band of lags only, so a gram meets at
   most 2 m places and a band at most LEAST pairs a word, however often a word repeats.
3. Pairs go by lag and place. A table of the furthest place that each lag has covered skips
   pairs inside a segment known already; the first pair of a segment is extended both ways, by comparing
   exact names of stretches of 1, 2, 4 ... words.
4. Segments on several lags that cover the same words have the smallest one as period.

A document without an equal pair of SEED-grams has no run and leaves after one sort of hashes.
Documents never meet: their words are apart by separators that occur once.

A null text counts as empty; a null doc_id stays null; repeated rows get equal results; other
columns are ignored; an empty table gives an empty table. A task holds the words of some texts, or of a
single long one, with one array of names for each doubling of its longest repetition.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, arrow_schema, id_text, joined_hashes, mix, public_id, runs, text_buffers

LEAST = 12  # words of a run
SEED = LEAST // 2  # overlap that every run with a period below LEAST has
BYTES = 4 << 20  # of texts worked on together
PAIRS = 2_000_000  # occurrence pairs held at a time
BASE = 0x9E3779B97F4A7C15

#: (doc_id, words) -> which original word stands at each place; None leaves the text as it is.
Edit = Callable[[int | None, int], "np.ndarray | None"]


class Names:
    """Exact names of the stretches of 1, 2, 4 ... words from each place on."""

    def __init__(self, ids: np.ndarray):
        self.levels = [ids]
        while True:
            last, size = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= size:
                break
            name, largest = _named(last[:-size], last[size:])
            if largest + 1 == len(name):  # nothing of this length repeats
                break
            self.levels.append(name)

    def grams(self, k: int) -> np.ndarray | None:
        """Equal numbers for equal stretches of ``k`` words; None if none of this length repeats."""
        j = k.bit_length() - 1
        if j >= len(self.levels):
            return None
        names, apart = self.levels[j], k - (1 << j)
        return _named(names[: len(names) - apart], names[apart:])[0] if apart else names

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are equal."""
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names = self.levels[level]
            fits = j + got < len(names)  # j is the later place
            at = np.flatnonzero(fits)
            same = names[i[at] + got[at]] == names[j[at] + got[at]]
            got[at[same]] += 1 << level
        return got

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and before ``j`` are equal."""
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], 1 << level
            at = np.flatnonzero((i - got >= size) & (j - got - size < len(names)))
            same = names[i[at] - got[at] - size] == names[j[at] - got[at] - size]
            got[at[same]] += size
        return got


def _named(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers that are equal where both parts are, and the largest of them."""
    keys = left.astype(np.int64) << 32 | right.astype(np.int64)
    if not len(keys):
        return np.zeros(0, np.int32), -1
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int32)
    changes = np.r_[0, (np.diff(keys[order]) != 0).cumsum()]
    new[order] = changes
    return new, int(changes[-1])


def pairs(grams: np.ndarray, step: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of equal grams ``low`` to ``high`` places apart, from places divisible by ``step``."""
    n = len(grams)
    often = np.bincount(grams)[grams] > 1
    places = np.flatnonzero(often)
    keys = grams[places].astype(np.int64) * (n + 1)
    index = np.sort(keys + places)
    starts = places % step == 0
    places, keys = places[starts], keys[starts]
    first = np.searchsorted(index, keys + np.minimum(places + low, n))
    last = np.searchsorted(index, keys + np.minimum(places + high + 1, n))
    counts = last - first
    some = counts > 0
    places, first, counts = places[some], first[some], counts[some]
    block = np.cumsum(counts) // PAIRS
    for a, b in _blocks(block):
        count = counts[a:b]
        at = np.repeat(first[a:b], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(places[a:b], count)
        yield place, index[at] % (n + 1) - place


def _blocks(block: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = runs([block])
    yield from zip(starts.tolist(), np.r_[starts[1:], len(block)].tolist())


def uncovered(place: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that start beyond the furthest place covered on their lag by the pairs before them."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    furthest = np.r_[-1, place[:-1] + k]  # of the pair before, which covers its k words
    new = (place > furthest) | np.r_[True, lag[1:] != lag[:-1]]
    return place[new], lag[new]


def segments(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period. ``longest``: words of the longest document."""
    names = Names(ids)
    found = [np.zeros((3, 0), np.int64)]
    low, high, k, step = 1, LEAST - 1, SEED, 1
    while 2 * low <= longest:
        grams = names.grams(k)
        if grams is None:
            break
        for place, lag in pairs(grams, step, low, high):
            place, lag = uncovered(place, lag, k)
            start = place - names.before(place, place + lag)
            end = place + lag + names.after(place, place + lag)
            long = end - start >= np.maximum(LEAST, 2 * lag)
            found.append(np.stack([start[long], end[long], lag[long]]))
        low, high = high + 1, 2 * high + 1
        k = step = low // 2
    start, end, lag = np.concatenate(found, axis=1)
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    once = runs([start, end])
    start, end, lag = start[once], end[once], lag[once]
    order = np.lexsort((lag, start))
    return start[order], end[order], lag[order]


def suspects(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which documents may hold an equal pair of SEED-grams: by hashes, so never too few."""
    counts = np.maximum(np.diff(begins) - SEED + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[doc]
    hashes = joined_hashes(mix(ids), SEED, BASE)[place] if len(doc) else np.zeros(0, np.uint64)
    keys = np.sort((hashes & np.uint64((1 << 40) - 1)) | doc.astype(np.uint64) << np.uint64(40))
    twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(40)
    return np.unique(twice).astype(np.int64)


def runs_of(split: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Per document, given as numbers of words, its runs as rows (start, length, period)."""
    begins = np.r_[0, np.cumsum([len(x) for x in split])]
    ids = np.concatenate([*split, np.zeros(0, np.int64)])
    some = suspects(ids, begins)
    if not len(some):
        return {}
    new = int(ids.max()) + 1
    parts: list[np.ndarray] = []
    for k, i in enumerate(some.tolist()):
        parts += [split[i], np.array([new + k])]
    at = np.cumsum([0, *[len(split[i]) + 1 for i in some.tolist()]])
    start, end, lag = segments(np.concatenate(parts), int(np.diff(at).max()) - 1)
    doc = np.searchsorted(at, start, side="right") - 1
    out = {}
    firsts = runs([doc])
    for a, b in zip(firsts, np.r_[firsts[1:], len(doc)]):
        d = int(doc[a])
        out[int(some[d])] = np.stack([start[a:b] - at[d], (end - start)[a:b], lag[a:b]], axis=1)
    return out


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def _shares(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BYTES."""
    yield from _blocks((ends[1:] - ends[0]) // BYTES)


def collapse(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed`` per row.

    ``collapsed`` has the words outside of runs and the first period of each, joined by
    single spaces. ``edit`` rearranges the words of a document first.
    """
    schema = "did long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    target = arrow_schema(docs.sparkSession, schema)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids = batch.column(0).to_pylist()
            data, ends = text_buffers(batch.column(1))
            for lo, hi in _shares(ends):
                split = [data[a:b].tobytes().split() for a, b in zip(ends[lo:hi].tolist(), ends[lo + 1 : hi + 1].tolist())]
                if edit is not None:
                    for i, words in enumerate(split):
                        did = dids[lo + i]
                        order = edit(None if did == NO_ID else did, len(words))
                        if order is not None:
                            split[i] = [words[j] for j in order.tolist()]
                known = {w: i for i, w in enumerate({w for words in split for w in words})}
                numbers = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in split]
                found = runs_of(numbers)
                rows, texts = [], []
                for i, words in enumerate(split):
                    mine = found.get(i)
                    rows.append([] if mine is None else [dict(zip(("start", "length", "period"), r)) for r in mine.tolist()])
                    if mine is not None:
                        words = [words[j] for j in np.flatnonzero(kept_words(len(words), mine)).tolist()]
                    texts.append(b" ".join(words).decode())
                counts = pa.array([len(w) for w in split], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), counts, pa.array(rows, target.field(2).type), pa.array(texts, pa.string())],
                    schema=target,
                )

    return id_text(docs).mapInArrow(task, schema).select(public_id(), "n_words", "runs", "collapsed")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's edit: of documents whose id has a crc32 divisible by ten the words repeat with a lag from some place on.

    A document without an id is left as it is.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def summary(collapsed: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of ``collapse``'s rows."""

    def ordered(r: Column) -> Column:
        return F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))

    most = F.array_max(F.transform("runs", ordered))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return collapsed.withColumn("most", most).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("most.s")).alias("start"),
        F.col("most.length").alias("length"),
        (-F.col("most.p")).alias("period"),
        F.expr("most.length * 1000 div -most.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
