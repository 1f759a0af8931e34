"""Quality rules as a short-circuit cascade.

A rule looks at one text and says whether to reject it. Each task measures every
rule's time and rejections on its first ``sample`` texts, then asks the rules in the
order of rejections per second and stops at the first that rejects. A rule is timed on
forms of its own, so none pays for what another has made. The verdict is the disjunction
of the rules, so it doesn't depend on the order a task finds. ``keep`` has the base rules
in the cascade, too; ``quality`` returns their measures and so takes them for every text.

Nulls and empties: a null text counts as empty, an empty text has no words and fails
the base rules, a null doc_id stays null, equal rows get equal results, extra columns
are ignored by ``quality`` and kept by ``keep``. An empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.common import SPACES, by_row, id_text, public_id

SYMBOLS = "#*$%&|<>"
SAMPLE = 200  # texts of a task on which cost and selectivity are estimated
WINDOW = 5


class Text:
    """One text with its derived forms, each made once."""

    def __init__(self, text: str):
        self.text = text
        self.words = text.encode().split()  # bytes split at exactly [\x20\x09-\x0D]
        self.word_chars = len(text) - sum(map(text.count, SPACES))
        self._lines: list[str] | None = None
        self._symbols: int | None = None
        self._repeated: int | None = None

    @property
    def lines(self) -> list[str]:
        if self._lines is None:
            self._lines = [x for x in self.text.split("\n") if x.strip(SPACES)]
        return self._lines

    @property
    def symbols(self) -> int:
        if self._symbols is None:
            self._symbols = sum(map(self.text.count, SYMBOLS))
        return self._symbols

    @property
    def dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def repeated_words(self) -> int:
        """Words inside a five-word window that occurs at least twice."""
        if self._repeated is None:
            self._repeated = self._count_repeated()
        return self._repeated

    def _count_repeated(self) -> int:
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        ids = dict(zip(dict.fromkeys(self.words), range(n + WINDOW)))
        codes = np.fromiter(map(ids.__getitem__, self.words), np.uint64, n + WINDOW - 1)
        with np.errstate(over="ignore"):
            keys = codes[:n].copy()
            for j in range(1, WINDOW):
                keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        order = np.sort(keys)
        doubles = order[1:][order[1:] == order[:-1]]
        if not len(doubles):
            return 0
        at = np.flatnonzero(np.isin(keys, doubles))
        windows = [codes[i : i + WINDOW].tobytes() for i in at.tolist()]  # the hash only nominates
        seen = Counter(windows)
        covered = np.zeros(n + WINDOW, np.int32)
        for i, w in zip(at.tolist(), windows):
            if seen[w] > 1:
                covered[i] += 1
                covered[i + WINDOW] -= 1
        return int((np.cumsum(covered) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _many_symbols(t: Text) -> bool:
    return t.symbols > 0.3 * len(t.words)


def _odd_word_length(t: Text) -> bool:
    return not 2 <= t.word_chars / max(1, len(t.words)) <= 25


def _same_lines(t: Text) -> bool:
    return 2 * t.dup_lines > len(t.lines)


def _shouting(t: Text) -> bool:
    return sum(map(bytes.isupper, t.words)) > 0.7 * len(t.words)


def _mostly_digits(t: Text) -> bool:
    return sum(map(t.text.count, "0123456789")) > 0.7 * t.word_chars


def _few_words(t: Text) -> bool:
    return len(t.words) < 10


def _repeated_windows(t: Text) -> bool:
    return 100 * t.repeated_words() > 20 * len(t.words)


BASE = (Rule("few_words", _few_words), Rule("repeated_windows", _repeated_windows))

RULES = (
    Rule("many_symbols", _many_symbols),
    Rule("odd_word_length", _odd_word_length),
    Rule("same_lines", _same_lines),
    Rule("shouting", _shouting),
    Rule("mostly_digits", _mostly_digits),
)


@dataclass
class Cascade:
    """Asks rules in the order of rejections per second, learnt on the first texts."""

    rules: Sequence[Rule]
    sample: int = SAMPLE
    seen: int = 0
    spent: dict[str, float] = field(default_factory=Counter)
    rejected: dict[str, int] = field(default_factory=Counter)

    def __post_init__(self) -> None:
        self.order = list(self.rules)

    def rejects(self, text: Text) -> bool:
        if self.seen >= self.sample:
            return any(rule.rejects(text) for rule in self.order)
        verdict = False
        for rule in self.rules:
            fresh = Text(text.text)
            start = time.perf_counter()
            said = bool(rule.rejects(fresh))
            self.spent[rule.name] += time.perf_counter() - start
            self.rejected[rule.name] += said
            verdict |= said
        self.seen += 1
        if self.seen == self.sample:
            # One rejection more than seen, so that rules that never rejected go by cost.
            self.order.sort(key=lambda r: -(self.rejected[r.name] + 1) / (self.spent[r.name] + 1e-9))
        return verdict


SCHEMA = (
    "did long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean"
)


def _measure(rules: Sequence[Rule], sample: int):
    def make():
        cascade = Cascade(rules, sample)

        def row(did: int, text: str) -> tuple:
            t = Text(text)
            n, repeated = len(t.words), t.repeated_words()
            failed = any(rule.rejects(t) for rule in BASE)
            kept = not failed and not cascade.rejects(t)
            return did, n, t.word_chars, t.symbols, t.dup_lines, repeated, failed, kept

        return row

    return make


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Base measures and the cascade's verdict, one row per row of ``docs``."""
    out = by_row(id_text(docs), _measure(rules, sample), ["did", "text"], SCHEMA)
    return out.select(public_id(), *out.columns[1:])


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that neither a base rule nor one of ``rules`` rejects, with all their columns, in one pass."""
    columns = docs.columns
    at = columns.index("text")
    target = docs.schema

    def task(batches):
        cascade = Cascade((*BASE, *rules), sample)
        for batch in batches:
            good = [not cascade.rejects(Text(text or "")) for text in batch.column(at).to_pylist()]
            yield batch.filter(_mask(good))

    return docs.mapInArrow(task, target)


def _mask(flags: list[bool]):
    import pyarrow as pa

    return pa.array(flags, type=pa.bool_())
