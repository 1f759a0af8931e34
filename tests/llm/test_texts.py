"""Operators that look at one text, or at a text and its successor, against brute force."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tests.llm.rows import odd_rows, plain
from tokenizers import Tokenizer

from skein.llm import bpe, fingerprint, licenses, pii, quality

BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# --- licences ---


def scan_fully(text):
    """Alignment of every template over the whole text, without an index."""
    index = licenses.Index(licenses.TEMPLATES)
    numbers = index.number(licenses.words_of(text))
    return {
        name
        for name, template in zip(index.names, index.templates)
        if len(numbers)
        and licenses.align(template, numbers, -len(template), len(numbers))[0] >= licenses.COVERAGE * len(template)
    }


def test_licenses_equal_full_alignment(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randint(0, len(words) // 12)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["zzz"], [words[at], "qqq"]])
        rows.append((i, " ".join(rng.choices(["the", "of", "licence", "foo"], k=rng.randint(0, 30)) + words + ["bar é"] * 9)))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, text in rows:
        mine = [r for r in found if r.doc_id == i]
        assert {r.template for r in mine} == scan_fully(text)
        for r in mine:
            assert 0 <= r.start < r.end <= len(text) and r.coverage >= licenses.COVERAGE


def test_licenses_find_one_word_edits_of_every_template():
    index = licenses.Index(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        words = licenses.words_of(template)
        for at in range(len(words)) if len(words) < 30 else range(0, len(words), 15):
            for new in ([], ["zzz"], [words[at], "qqq"]):
                text = " ".join(["foo", "of", "the", *words[:at], *new, *words[at + 1 :], "bar"])
                got = {m[0] for m in licenses.matches(index, text, licenses.COVERAGE)}
                assert got == scan_fully(text), (name, text)
    (found,) = licenses.matches(index, "Released under MIT License", licenses.COVERAGE)
    assert found[:3] == ("MIT notice", 0.8, 4)


def test_licenses_find_many_edits_of_short_notices():
    index, rng = licenses.Index(licenses.TEMPLATES), random.Random(4)
    short = [t for t in map(licenses.words_of, licenses.TEMPLATES.values()) if len(t) < licenses.SHORT]
    for _ in range(400):
        words = list(rng.choice(short))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["zzz"], [words[at], "qqq"]])
        text = " ".join(words)
        assert {m[0] for m in licenses.matches(index, text, licenses.COVERAGE)} == scan_fully(text), text


def test_licenses_of_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 0
    assert licenses.scan(none).collect() == []


def test_license_spans_are_code_points(spark):
    text = "é" * 9 + " Released under the MIT License. Released under the MIT License"
    (one, two) = sorted(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert text[one.start : one.end] == text[two.start : two.end] == "Released under the MIT License"


# --- fingerprints ---


def test_fingerprints(spark, docs, texts):
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    for k, (doc_id, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert r.fingerprint == fingerprint.written(fingerprint.chunks(text))
        assert r.near_edited == fingerprint.likeness(fingerprint.chunks(text), fingerprint.chunks(edited))
        assert r.near_next == fingerprint.likeness(fingerprint.chunks(text), fingerprint.chunks(after))


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(4)
    data = bytes(rng.choices(range(97, 123), k=20_000))
    ends = fingerprint.ends(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and max(sizes) <= fingerprint.MOST and min(sizes[:-1]) >= fingerprint.LEAST
    h = 0
    for i, byte in enumerate(data[:300]):  # the rolling definition
        h = (h * 2 + int(fingerprint.GEAR[byte])) % 2**32
        assert h == fingerprint.gear(data)[i]
    text = data.decode()
    assert fingerprint.likeness(fingerprint.chunks(text), fingerprint.chunks("moved " + text)) > 0.95


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == len(odd_rows())
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in odd_rows()))
    want = []
    for k, (known, doc_id, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][2]
        want.append((doc_id if known else None, sha(text[: len(text) - len(text) // 2] + after[: len(text) // 2])))
    assert plain((r.doc_id, r.edited_sha256) for r in rows) == plain(want)
    assert fingerprint.fingerprints(none).collect() == []


# --- personal data ---


def base_spans(text):
    """The contract's patterns, searched from left to right."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


@pytest.mark.parametrize("letters", ["a@.1+- ", "ab@.-%", "0123456789.", "0123456789 -", "+0123456789(). -", "4 -0"])
def test_pii_base_spans(letters):
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_pii_query(docs, texts):
    rows = {r.doc_id: r for r in pii.summary(pii.find(docs)).collect()}
    for doc_id, text in texts:
        want = base_spans(text)
        assert rows[doc_id].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert rows[doc_id].n_email == sum(k == "email" for k, _, _ in want)


def test_pii_beyond_the_base():
    text = 'IBAN DE89 3704 0044 0532 0130 00, see https://a.example/x. Account: 12345678; token = "0123456789abcdef"'
    found = {k: text[a:b] for k, a, b in pii.spans(text)}
    assert found["iban"] == "DE89 3704 0044 0532 0130 00" and found["url"] == "https://a.example/x"
    assert found["account"] == "12345678" and found["secret"] == "0123456789abcdef"
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.mark.parametrize("text, kind, want", [
    ("IBAN: DE89 3704 0044 0532 0130 00 BIC COBADEFF", "iban", ["DE89 3704 0044 0532 0130 00"]),
    ("IBAN: DE89370400440532013000 BIC: X", "iban", ["DE89370400440532013000"]),
    ("IBAN GB82 WEST 1234 5698 7654 32 A B C, iban: NO93 8601 1117 947 OK", "iban",
     ["GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]),
    ("IBAN: ZZ40 3704 0044 0532 0130 00 BIC X", "iban", []),
    ("IBAN: DE88 3704 0044 0532 0130 00 BIC COBADEFF", "iban", []),
    ("account number: 12345678, Account No. 87654321; acct nr 55555", "account", ["12345678", "87654321", "55555"]),
    ("account: 12345 account: 1234 account: 1--234 account none 12345", "account", ["12345"]),
    ("account: " + "1234567890" * 4 + " x", "account", ["1234567890" * 4]),
    ("token=" + "aB3_" * 200 + ". End", "secret", ["aB3_" * 200]),
    ("password: abc.def.ghi. secret = short12 token=a.b", "secret", ["abc.def.ghi"]),
    ("account_number=DE12345 numéro de compte n° 1234-5678", "account", ["DE12345", "1234-5678"]),
])
def test_pii_expansions_are_tried_again(text, kind, want):
    assert [text[a:b] for k, a, b in pii.spans(text) if k == kind] == want


def test_pii_of_odd_rows(odd, none):
    rows = pii.summary(pii.find(odd)).collect()
    assert len(rows) == len(odd_rows()) and {r.base_sha256 for r in rows} == {sha("")}
    assert pii.find(none).collect() == []


# --- BPE ---


def encoded(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return plain(out)


def test_bpe_equals_the_library(docs, texts, odd, none):
    library = Tokenizer.from_file(BPE)
    for frame, rows in ((docs, texts), (odd, odd_rows())):
        assert plain(bpe.summary(bpe.decode(bpe.encode(frame, BPE), BPE)).collect()) == encoded(library, rows)
        assert plain(bpe.summary(bpe.encode(frame, BPE, decoded=True)).collect()) == encoded(library, rows)
    assert bpe.encode(none, BPE).collect() == []


def test_bpe_of_odd_texts(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 50)  # caches overflow
    monkeypatch.setattr(bpe, "PAIR_BITS", 5)
    monkeypatch.setattr(bpe, "CELLS", 300)
    bpe.vocabulary.cache_clear()
    library, mine, rng = Tokenizer.from_file(BPE), bpe.Encoder(BPE), random.Random(1)
    bpe.vocabulary.cache_clear()
    letters = [*"aeiou bcdt  \n\t'sreé1 2.,!ß€漢😀", "<|endoftext|>", "՘", "​", " ", "\x1c", "\x00"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a" * 3000, "don't we'll 'S", "  x", "x  ", "--------------------------"]
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        want = [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        ids, bounds = mine.encode(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert [len(x) for x in mine.encode(pa.array([], pa.string()))] == [0, 1]


# --- quality ---


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit, times = set(), Counter(windows)
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 5))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit), failed


def test_quality_measures(docs, texts, odd, none):
    for frame, rows in ((docs, texts), (odd, odd_rows())):
        assert plain(tuple(r)[:-1] for r in quality.quality(frame).collect()) == plain((i, *measured(t or "")) for i, t in rows)
    assert quality.quality(none).collect() == []


def test_quality_keeps_good_documents(spark, docs, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.quality(docs).collect() if not r.base_failed and r.doc_id in labels]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert any(not r.kept for r in rows if labels[r.doc_id] == 0)


def test_cascade_orders_by_rejections_per_cost():
    import time

    calls = []

    def rule(name, cost, verdict):
        def rejects(t):
            calls.append(name)
            time.sleep(cost)
            return verdict(t)

        return quality.Rule(name, rejects)

    rules = [rule("slow", 0.004, lambda t: True), rule("never", 0, lambda t: False), rule("fast", 0.0005, lambda t: True)]
    cascade = quality.Cascade(rules, sample=5)
    for _ in range(5):
        assert cascade.rejects(quality.Text("x"))
    calls.clear()
    assert cascade.rejects(quality.Text("x"))
    assert calls[-1] == "fast" and "slow" not in calls


def test_cascade_spares_the_dear_rule():
    asked = []

    def repeats(t):
        asked.append(t)
        return 100 * t.repeated_words() > 20 * len(t.words)

    dear = quality.Rule("repeated_windows", repeats)
    texts = [" ".join(f"W{i}X{j}" for j in range(300)) for i in range(60)]  # shouting, nothing repeats
    cascade = quality.Cascade((dear, *quality.RULES), sample=10)
    assert all(cascade.rejects(quality.Text(t)) for t in texts)
    assert len(asked) == 10  # the sample only


def test_rules_are_priced_on_their_own():
    made = []

    def rule(name):
        def rejects(t):
            made.append(t._lines is None)
            return t.dup_lines > 5

        return quality.Rule(name, rejects)

    cascade = quality.Cascade([rule("a"), rule("b")], sample=3)
    for _ in range(3):
        cascade.rejects(quality.Text("x\n" * 3))
    assert all(made) and len(made) == 6


def test_keep_is_the_verdict(odd, none):
    assert quality.keep(none).collect() == []
    kept = plain((r.doc_id, r.n_words) for r in quality.quality(odd).collect() if r.kept)
    rows = quality.keep(odd)
    assert rows.schema == odd.schema
    assert plain((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in rows.collect()) == kept
