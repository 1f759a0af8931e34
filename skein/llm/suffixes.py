"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that an earlier document has.

1. Every window of ``length`` bytes owns one anchor, its smallest hashed gram, which depends on
   the window's bytes alone; a document ships the hashes of its anchors. Anchors seen in two or
   more different texts come back to their documents.
2. Around each such anchor the windows that own it form a neighbourhood of less than twice
   ``length`` bytes. Equal neighbourhoods are pre-aggregated to the smallest document that has them.
3. The distinct neighbourhoods are dealt to shards by anchor. A shard builds the suffix
   array of its text by Larsson-Sadakane refinement: suffixes sorted by 8 bytes are
   refined to 16 and 32 by the ranks of the suffixes 8 and 16 further on, and only groups still
   unsorted are touched. Neighbours in the array whose common prefix reaches ``length`` hold the same
   string; the smallest document of each run decides over its windows.
4. Equal strings own equal anchors, so shards need no merging, unless an anchor has more than
   CROWD distinct neighbourhoods: those anchors leave the shards, and their strings
   are matched by a grouped aggregate over the strings themselves.
5. Verdicts go back to the occurrences of a neighbourhood, then as spans to the documents.

Texts that repeat an earlier document's text whole are covered as a whole and take no part.
A null text counts as empty; a null doc_id counts as smaller than every other id. Rows that
share a doc_id are one document: they don't cover each other. Other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import repeats
from skein.llm.common import arrow_schema, joined_hashes, public_id, runs, text_buffers
from skein.llm.repeats import Method, merged_lists

LENGTH = 50  # bytes
GRAM = 24  # bytes of an anchor
PIECE = 1 << 18  # bytes that are hashed at a time: their hashes stay in a core's cache
AT = np.uint64((1 << 24) - 1)  # low bits of a packed hash: the place in the piece
BASE = 0x9E3779B97F4A7C15


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, place of the first owning window, number of owning windows, hash) of each anchor.

    ``data`` holds the texts, text i from ends[i] to ends[i + 1]; places are in the text. A text
    longer than a piece is hashed in parts that share length - 1 bytes.
    """
    out: list[tuple[np.ndarray, ...]] = []
    parts: list[tuple[int, int, int]] = []

    def flush() -> None:
        if not parts:
            return
        joined = np.concatenate([data[a:b] for _, a, b in parts])
        sizes = np.array([b - a for _, a, b in parts])
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        hashes = joined_hashes(joined.astype(np.uint64), GRAM, BASE)
        packed = hashes & ~AT | np.arange(len(hashes), dtype=np.uint64)
        owner = smallest(packed, length - GRAM + 1)
        part = np.repeat(np.arange(len(parts)), sizes - length + 1)
        counts = np.r_[0, np.cumsum(sizes - length + 1)]
        window = np.arange(counts[-1]) - np.repeat(counts[:-1] - begins, sizes - length + 1)
        at = (owner[window] & AT).astype(np.int64)
        first = runs([part, at])
        doc = np.array([d for d, _, _ in parts])[part[first]]
        place = window[first] + (np.array([a for _, a, _ in parts]) - begins)[part[first]] - ends[doc]
        out.append((doc, place, np.diff(np.r_[first, len(at)]), hashes[at[first]]))
        parts.clear()

    held = 0
    for doc in np.flatnonzero(np.diff(ends) >= length).tolist():
        a, b = int(ends[doc]), int(ends[doc + 1])
        while b - a >= length:
            to = min(b, a + PIECE)
            parts.append((doc, a, to))
            held += to - a
            a = to - length + 1
            if held >= PIECE:
                flush()
                held = 0
    flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number that sorts as the two ranks do; ranks are from -1 to 2**31 - 2."""
    return first << 32 | second + 1


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes (8 times a power of two), and their ranks.

    Equal ranks mean equal prefixes; the text is taken to go on with zeros.
    """
    n = len(text)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key[: n - i] |= text[i:]
    sa = np.argsort(key)
    heads = runs([key[sa]])
    sizes = np.diff(np.r_[heads, n])
    rank = np.empty(n + depth, np.int64)
    rank[n:] = -1
    rank[sa] = np.repeat(heads, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # members of groups still unsorted
    step = 8
    while step < depth and len(slots):
        members = sa[slots]
        both = paired(rank[members], rank[members + step])
        order = np.argsort(both)
        members, both = members[order], both[order]
        sa[slots] = members
        first = runs([both])
        sizes = np.diff(np.r_[first, len(slots)])
        rank[members] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        step *= 2
    return sa, rank


def smallest_holder(texts: list[bytes], dids: np.ndarray, length: int) -> np.ndarray:
    """The smallest did of each window of each text, from the suffix array of the shard."""
    sizes = np.array([len(t) for t in texts])
    whole = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[owner] + place
    depth = 8
    while 2 * depth <= length:
        depth *= 2
    sa, rank = suffix_array(whole, depth)
    # A common prefix of ``length`` bytes: the first ``depth`` agree, and the last ``depth``.
    both = paired(rank[at], rank[at + length - depth])
    order = np.argsort(both)
    starts = runs([both[order]])
    least = np.minimum.reduceat(dids[owner[order]], starts) if len(starts) else np.zeros(0, np.int64)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[starts, len(order)]))
    return out


def _anchor_hashes(length: int):
    def per_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = text_buffers(texts)
        doc, _, _, hashes = anchors(data, ends, length)
        return doc, hashes

    return per_text


def _around(length: int):
    def around(texts: pa.Array, is_shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        data, ends = text_buffers(texts)
        doc, place, count, hashes = anchors(data, ends, length)
        held = is_shared(doc, hashes)
        doc, place, count, hashes = doc[held], place[held], count[held], hashes[held]
        begin = ends[doc] + place
        found = zip(begin.tolist(), (begin + count - 1 + length).tolist())
        whole = data.tobytes()
        return doc, place, hashes, [whole[a:b] for a, b in found]

    return around


def method(length: int) -> Method:
    return Method(
        length,
        _anchor_hashes(length),
        _around(length),
        lambda content: len(content) - length + 1,
        lambda content, x: content[x : x + length],
        lambda contents, dids: smallest_holder(contents, dids, length),
    )


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(did, text, whole, spans): covered bytes; ``whole`` where the text repeats that of a smaller did."""
    return repeats.dedup(docs, method(length))


def summary(marked: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts and digests of ``dedup``'s rows."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = text_buffers(batch.column(1))
            row, begin, end = merged_lists(batch.column(3))
            # A whole copy has no spans: all of it is lost, if any window fits.
            sizes = np.diff(ends)
            whole = batch.column(2).to_numpy(zero_copy_only=False) & (sizes >= length)
            n_spans = np.bincount(row, minlength=len(sizes))
            first = np.r_[0, np.cumsum(n_spans)].tolist()
            removed = np.r_[0, np.cumsum(end - begin)]
            n_removed = np.where(whole, sizes, np.diff(removed[first]))
            begins, stops = (ends[row] + begin).tolist(), (ends[row] + end).tolist()
            view, digests = memoryview(data), []
            for i, (at, stop) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                digest = hashlib.sha256()
                if not whole[i]:
                    for k in range(first[i], first[i + 1]):
                        digest.update(view[at : begins[k]])
                        at = stops[k]
                    digest.update(view[at:stop])
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (sizes, n_removed, np.where(whole, 1, n_spans), digests))], schema=target
            )

    schema = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    target = arrow_schema(marked.sparkSession, schema)
    out = marked.select("did", "text", "whole", "spans").mapInArrow(task, schema)
    return out.select(public_id(), *out.columns[1:])
