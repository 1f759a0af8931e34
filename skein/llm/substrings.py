"""Substring dedup by difference-cover anchors: words covered by a window that an earlier document has.

A window is ``WINDOW`` consecutive words. COVER holds places modulo PERIOD such that every
difference modulo PERIOD occurs between two of them. So for any two equal windows, at
whatever places of their documents, some shift below PERIOD brings both starts onto
cover places; there both documents have the same anchor of WINDOW - PERIOD + 1 words.
Only anchors at cover places are hashed. Where one is shared by different texts, the windows
around it are compared in full, by 128 bits of their words.

Texts that repeat an earlier document's text whole are covered as a whole and take no part.
A null text counts as empty; a null doc_id counts as smaller than every other id. Rows that
share a doc_id are one document: they don't cover each other. Other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from skein.llm import repeats
from skein.llm.common import by_row, joined_hashes, mix, public_id, runs, sha256, text_buffers
from skein.llm.repeats import Method, merged

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # fixed values: a perfect difference set modulo PERIOD
ANCHOR = WINDOW - PERIOD + 1
TEXTS = 500  # hashed at a time
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of some texts at a time: (rows, where each begins among the words, word hashes)."""
    data, ends = text_buffers(texts)
    for lo in range(0, len(ends) - 1, TEXTS):
        hi = min(lo + TEXTS, len(ends) - 1)
        split = [data[a:b].tobytes().split() for a, b in zip(ends[lo:hi].tolist(), ends[lo + 1 : hi + 1].tolist())]
        words = [w for x in split for w in x]
        known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        yield np.arange(lo, hi), np.r_[0, np.cumsum([len(x) for x in split])], hashes


def _anchor_places(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among all words) of the anchors at cover places."""
    counts = np.diff(begins)
    counts = np.where(counts >= WINDOW, counts - ANCHOR + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.isin(place % PERIOD, COVER)
    return doc[at], place[at] + begins[doc[at]]


def anchors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for rows, begins, words in parts(texts):
        doc, at = _anchor_places(begins)
        if len(doc):
            docs.append(rows[doc])
            hashes.append(joined_hashes(words, ANCHOR, BASES[0])[at])
    return np.concatenate(docs), np.concatenate(hashes)


def around(texts: pa.Array, is_shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Runs of candidate windows with one owner: the smallest anchor-length hash inside the window."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    contents: list[bytes] = []
    for rows, begins, words in parts(texts):
        doc, at = _anchor_places(begins)
        if not len(doc):
            continue
        grams = joined_hashes(words, ANCHOR, BASES[0])
        shared = is_shared(rows[doc], grams[at])
        doc, at = doc[shared], at[shared]
        # Windows that hold a shared anchor: starts from at - PERIOD + 1 to at, inside the text.
        low = np.maximum(at - PERIOD + 1, begins[doc])
        high = np.minimum(at, begins[doc + 1] - WINDOW)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high + 1, -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(start):
            continue
        owner = np.lib.stride_tricks.sliding_window_view(grams, PERIOD)[start].min(axis=1)
        first_hash, second_hash = (joined_hashes(mix(words, i), WINDOW, b)[start] for i, b in enumerate(BASES))
        doc = np.searchsorted(begins, start, side="right") - 1
        first = runs([doc, owner, start - np.arange(len(start))])
        cuts = np.r_[first, len(start)].tolist()
        pairs = np.column_stack([first_hash, second_hash])
        contents += [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        out.append((rows[doc[first]], start[first] - begins[doc[first]], owner[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    return *(np.concatenate(c) for c in zip(*out)), contents


def least(contents: list[bytes], dids: np.ndarray) -> np.ndarray:
    """The smallest did of each window, over sorted window hashes."""
    a, b = np.frombuffer(b"".join(contents), np.uint64).reshape(-1, 2).T
    holder = np.repeat(dids, [len(c) // 16 for c in contents])
    order = np.lexsort((b, a))
    starts = runs([a[order], b[order]])
    out = np.empty(len(a), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(holder[order], starts), np.diff(np.r_[starts, len(a)]))
    return out


METHOD = Method(
    WINDOW, anchors, around, lambda content: len(content) // 16, lambda content, x: content[16 * x : 16 * x + 16], least
)


def dedup(docs: DataFrame) -> DataFrame:
    """(did, text, whole, spans): covered words; ``whole`` where the text repeats that of a smaller did."""
    return repeats.dedup(docs, METHOD)


def summary(marked: DataFrame) -> DataFrame:
    """Counts and digests of ``dedup``'s rows."""

    def make():
        def row(did, text, whole, spans):
            words = text.encode().split()
            lost = merged((s["start"], s["end"]) for s in spans or ())
            if whole and len(words) >= WINDOW:
                lost = [(0, len(words))]
            kept, at = [], 0
            for a, b in lost:
                kept += words[at:a]
                at = b
            kept += words[at:]
            return did, len(words), sum(b - a for a, b in lost), sha256(b" ".join(kept))

        return row

    out = by_row(
        marked, make, ["did", "text", "whole", "spans"],
        "did long, n_words long, n_removed long, kept_sha256 string",
    )
    return out.select(public_id(), *out.columns[1:])
