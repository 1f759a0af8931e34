"""Operators that compare documents, against brute force; the pipeline, stage by stage."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import corpus_pipeline
from skein.llm import jaccard, lines, mixing, quality, repeats, substrings, suffixes
from tests.llm.rows import odd_rows, plain

NO_ID = -(1 << 63)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def id_of(doc_id):
    return NO_ID if doc_id is None else doc_id


def small(spark, texts, **kwargs):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(4)


# --- lines ---


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def deduped_lines(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add(id_of(doc_id))
    out = []
    for doc_id, text in rows:
        whole = (text or "").split("\n")
        left = []
        for line in whole:
            key = line_key(line)
            if len(key) < 20 or len(holders[key]) < 3 or id_of(doc_id) == max(holders[key]):
                left.append(line)
        out.append((doc_id, len(whole), len(whole) - len(left), sha("\n".join(left))))
    return plain(out)


def test_lines(docs, texts, odd, none):
    for frame, rows in ((docs, texts), (odd, odd_rows())):
        assert plain(lines.summary(frame, lines.keep_bitmaps(frame)).collect()) == deduped_lines(rows)
    assert lines.summary(none, lines.keep_bitmaps(none)).collect() == []


def test_a_line_of_most_documents_is_spread(spark):
    hot = "This very line is in nearly all of the documents"
    rows = [(i, f"{hot}\nown line of document number {i}\n{hot}") for i in range(4000)]
    frame = small(spark, rows)
    assert plain(lines.summary(frame, lines.keep_bitmaps(frame)).collect()) == deduped_lines(rows)
    ranged = lines.hashed_lines(lines.id_text(frame), 20).repartitionByRange(8, "a", "b", "did")
    parts = [r[0] for r in ranged.groupBy(lines.F.spark_partition_id()).count().select("count").collect()]
    assert max(parts) < 3 * sum(parts) / 8


def test_dropped_lines_keep_the_other_columns(odd):
    left = lines.drop_lines(odd, lines.keep_bitmaps(odd))
    assert left.columns == odd.columns
    assert plain((r.doc_id, sha(r.text)) for r in left.collect()) == plain((i, h) for i, _, _, h in deduped_lines(odd_rows()))
    assert plain(r[2:] for r in left.collect()) == plain(r[2:] for r in odd.collect())


# --- bytes and words that earlier documents have ---


def first_windows(items, length):
    first = {}
    for did, item in sorted(items, key=lambda x: x[0]):
        for s in range(len(item) - length + 1):
            first.setdefault(item[s : s + length], did)
    return first


def marks(items, length):
    first = first_windows(items, length)
    for did, item in items:
        lost = [False] * len(item)
        for s in range(len(item) - length + 1):
            if first[item[s : s + length]] < did:
                lost[s : s + length] = [True] * length
        yield lost


def deduped_bytes(rows):
    items = [(id_of(i), (t or "").encode()) for i, t in rows]
    out = []
    for (doc_id, _), (_, data), lost in zip(rows, items, marks(items, 50)):
        spans = sum(x and not (k and lost[k - 1]) for k, x in enumerate(lost))
        out.append((doc_id, len(data), sum(lost), spans, sha(bytes(c for c, x in zip(data, lost) if not x))))
    return plain(out)


def deduped_words(rows):
    items = [(id_of(i), tuple((t or "").encode().split())) for i, t in rows]
    out = []
    for (doc_id, _), (_, words), lost in zip(rows, items, marks(items, 50)):
        out.append((doc_id, len(words), sum(lost), sha(b" ".join(w for w, x in zip(words, lost) if not x))))
    return plain(out)


def stitched(rng, alphabet, low, high):
    parts = [" ".join(rng.choices(alphabet, k=rng.randint(low, high))) for _ in range(12)] + ["a " * 150, "a b " * 60]
    rows = [(i, " ".join(rng.choice(parts)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 5)))) for i in range(200)]
    return rows + [(None, parts[0] * 2), (5, parts[1] * 3), (7, parts[1] * 3), (7, parts[1] * 3), (7, "")]


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_suffix_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = stitched(random.Random(5), ["a", "b", "é c"], 10, 50)
    assert plain(suffixes.summary(suffixes.dedup(small(spark, rows))).collect()) == deduped_bytes(rows)


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_cover_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = stitched(random.Random(6), ["a", "b", "é c"], 30, 100)
    assert plain(substrings.summary(substrings.dedup(small(spark, rows))).collect()) == deduped_words(rows)


def test_dedup_of_tables(docs, texts, odd, none):
    for frame, rows in ((docs, texts), (odd, odd_rows())):
        assert plain(suffixes.summary(suffixes.dedup(frame)).collect()) == deduped_bytes(rows)
        assert plain(substrings.summary(substrings.dedup(frame)).collect()) == deduped_words(rows)
    assert suffixes.summary(suffixes.dedup(none)).collect() == []
    assert substrings.summary(substrings.dedup(none)).collect() == []


def test_suffix_array_sorts_to_its_depth():
    rng = random.Random(8)
    text = bytes(rng.choices(b"ab", k=400)) + b"ab" * 60 + b"a" * 50
    sa, rank = suffixes.suffix_array(suffixes.np.frombuffer(text, suffixes.np.uint8), 32)
    padded = text + b"\0" * 32
    heads = [padded[i : i + 32] for i in sa]
    assert heads == sorted(heads) and sorted(sa) == list(range(len(text)))
    for i in range(len(text)):
        for j in range(0, len(text), 7):
            assert (rank[i] == rank[j]) == (padded[i : i + 32] == padded[j : j + 32] or i == j)


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    rows = stitched(random.Random(9), ["a", "b", "é c"], 10, 50)
    texts = suffixes.pa.array([t for _, t in rows])
    whole = suffixes._around(50)(texts, lambda doc, hashes: hashes == hashes)
    monkeypatch.setattr(suffixes, "PIECE", 64)
    parts = suffixes._around(50)(texts, lambda doc, hashes: hashes == hashes)

    def windows(doc, place, owner, contents):
        return {(d, p + k, o, c[k : k + 50]) for d, p, o, c in zip(doc, place, owner, contents) for k in range(len(c) - 49)}

    assert len(parts[0]) > len(whole[0]) and windows(*parts) == windows(*whole)


@pytest.mark.parametrize("crowd", [60, 8])
def test_shards_are_filled_with_whole_owners(monkeypatch, crowd):
    """Up to SHARD rows and one stretch of owners at a time, however many a batch has; crowds pass."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SHARD", 10)
    rng = random.Random(10)
    owners = sorted(rng.choice([rng.randint(0, 300), 7, 150]) for _ in range(400))
    owners = [o for o in owners if o not in (7, 150)] + [7] * 9 + [150] * 50
    owners.sort()
    pa, np = suffixes.pa, suffixes.np
    rows = pa.table({
        "owner": owners, "nh": range(len(owners)), "around": [b"x"] * len(owners),
        "did": range(len(owners)), "last": [10**6] * len(owners),
    })
    taken = []

    def least(contents, dids):
        taken.append([owners[d] for d in dids])
        return dids

    method = repeats.Method(1, None, None, len, None, least)
    told = [b for b in repeats.verdicts(method)(rows.to_batches(max_chunksize=90))]
    crowds = {o for o in owners if owners.count(o) > crowd}
    assert crowds == ({7, 150} if crowd == 8 else set())
    passed = [o for b in told for o, x in zip(b["owner"].to_pylist(), b["least"].to_pylist()) if x is None]
    assert sorted(passed) == [o for o in owners if o in crowds]
    assert sorted(o for x in taken for o in x) == [o for o in owners if o not in crowds]
    assert all(len(set(a) & set(b)) == 0 for i, a in enumerate(taken) for b in taken[:i])
    assert len(taken) > 8 and max(map(len, taken)) <= 10 + 10 + max(owners.count(o) for o in set(owners) - crowds)
    assert np.concatenate([np.frombuffer(x, np.int64) for b in told for x in b["least"].to_pylist() if x]).size == sum(map(len, taken))


def test_membership_of_hashes():
    rng = suffixes.np.random.default_rng(11)
    hashes = rng.integers(0, 2**64, 5000, dtype="uint64")
    hashes[:3] = 0, 2**64 - 1, 2**63
    near = suffixes.np.r_[hashes, hashes + suffixes.np.uint64(1), hashes - suffixes.np.uint64(1)]
    for names in (hashes[:1], hashes[:2500], hashes):
        names = suffixes.np.unique(names)
        assert repeats.member(names)(near).tolist() == suffixes.np.isin(near, names).tolist()


def test_lists_of_spans_are_merged():
    rng = random.Random(12)
    rows = [[(a, a + rng.randint(1, 9)) for a in rng.choices(range(60), k=rng.randint(0, 9))] for _ in range(50)]
    rows += [None, [], [(0, 2**31 - 1)], [(5, 9), (0, 5)], [(0, 9), (2, 3), (4, 12)], None]
    kind = suffixes.pa.list_(suffixes.pa.struct([("start", suffixes.pa.int32()), ("end", suffixes.pa.int32())]))
    lists = [x if x is None else [{"start": a, "end": b} for a, b in x] for x in rows]
    for skip in (0, 7):
        found = repeats.merged_lists(suffixes.pa.array(lists, kind)[skip:])
        expected = [(i, a, b) for i, x in enumerate(rows[skip:]) for a, b in repeats.merged(x or [])]
        assert list(zip(*(c.tolist() for c in found))) == expected
    assert all(len(c) == 0 for c in repeats.merged_lists(suffixes.pa.array([None, []], kind)))


def test_cover_holds_every_difference():
    cover = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))


# --- similar documents ---


def shingle_set(text):
    words = (text or "").encode().split()
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def classes(rows):
    """(doc_id, class, links) from all pairs of texts that share a shingle."""
    distinct = list(dict.fromkeys(t or "" for _, t in rows))
    sets = [shingle_set(t) for t in distinct]
    holders = defaultdict(list)
    links = defaultdict(set)
    for k, s in enumerate(sets):
        common = Counter(o for x in s for o in holders[x])
        for o, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[o]) - n) - 1e-9:
                links[k].add(o)
                links[o].add(k)
        for x in s:
            holders[x].append(k)
    group = list(range(len(sets)))
    for k in range(len(sets)):  # flood from each text
        stack = [k]
        while stack:
            x = stack.pop()
            for o in links[x]:
                if group[o] > group[k]:
                    group[o] = group[k]
                    stack.append(o)
    number = {t: k for k, t in enumerate(distinct)}
    least = {}
    for doc_id, text in rows:
        g = group[number[text or ""]]
        least[g] = min(least.get(g, 1 << 62), id_of(doc_id))
    out = []
    for doc_id, text in rows:
        k = number[text or ""]
        c = least[group[k]] if sets[k] else id_of(doc_id)
        out.append((doc_id, None if c == NO_ID else c, len(links[k])))
    return out


def test_join(docs, texts, odd, none):
    for frame, rows in ((docs, texts), (odd, odd_rows())):
        assert plain(jaccard.summary(jaccard.join(frame)).collect()) == plain(classes(rows))
    assert jaccard.join(none).collect() == []


@pytest.mark.parametrize("limit, block", [(256, 1024), (20, 30)])
def test_join_of_large_classes(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    bases = [" ".join(rng.choices("abcde", k=80)) for _ in range(6)]

    def edited(text, n):
        words = text.split()
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        return " ".join(words)

    rows = [(i, edited(rng.choice(bases), rng.choice([0, 0, 1, 2, 3, 5]))) for i in range(200)]
    rows += [(400 + i, edited(bases[0], rng.randint(0, 2))) for i in range(120)] + [(7, "a b"), (8, "a b"), (9, "a  b")]
    got = plain(jaccard.summary(jaccard.join(small(spark, rows))).collect())
    want = plain(classes(rows))
    # The join finds a pair at the threshold with the target recall; closer pairs more surely.
    found, there = sum(r[2] for r in got), sum(r[2] for r in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want)) and found >= 0.999 * there
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)


def test_join_finds_all_links_of_groups_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 20)
    passage = [f"p{k}" for k in range(40)]  # of all groups, so buckets have to be split
    rows = []
    for g in range(4):
        for i in range(100):
            words = passage + [f"g{g}w{k}" for k in range(60)]
            words[(7 * i + g) % 100] = f"own{g}x{i}"
            rows.append((len(rows), " ".join(words)))
    got = plain(jaccard.summary(jaccard.join(small(spark, rows))).collect())
    assert got == plain(classes(rows)) and sum(r[2] for r in got) > 35_000


def test_misses_are_counted_over_shared_coordinates():
    n = jaccard.runs_needed(0.8, jaccard.DEPTH, jaccard.RECALL)
    assert jaccard.missed(0.8, jaccard.DEPTH, n) <= 1e-5 < jaccard.missed(0.8, jaccard.DEPTH, n - 1)
    rng, each, tries = random.Random(9), len(jaccard.step_coordinates(3, jaccard.DEPTH, 1)), 20_000

    def together(agree):
        return not agree or any(agree[0][c] and together(agree[1:]) for c in rng.sample(range(each), 2))

    lost = 0
    for _ in range(tries):
        agree = [[rng.random() < 0.8 for _ in range(each)] for _ in range(jaccard.DEPTH - 1)]
        lost += not any(rng.random() < 0.8 and together(agree) for _ in range(3))
    assert abs(lost / tries - jaccard.missed(0.8, jaccard.DEPTH, 3)) < 0.004


def test_runs_reach_the_recall():
    n = jaccard.runs_needed(0.8, jaccard.DEPTH, 0.999)
    assert 1 - (1 - jaccard.survival(0.8, jaccard.DEPTH)) ** n >= 0.999


# --- mixing ---


def scheduled(blocks, weights):
    """Slots by the definition: earliest deadline first until a source is used up, then again for the others."""
    rest, placed, out, t0 = dict(blocks), Counter(), {}, 0
    while any(rest.values()):
        active = {s: weights[s] for s, n in rest.items() if n}
        total, done, t = sum(active.values()), Counter(), 0
        while all(done[s] < rest[s] for s in active):
            ready = [
                (-(-(done[s] + 1) * total // w), -w, s) for s, w in active.items() if done[s] * total // w <= t
            ]
            s = min(ready)[2]
            out[t0 + t] = (s, placed[s] + done[s])
            done[s] += 1
            t += 1
        for s in active:
            rest[s] -= done[s]
            placed[s] += done[s]
        t0 += t
    return out


def stays_near(slots, blocks, weights):
    """Whether every source is less than a block off its weight at every slot, from phase to phase."""
    rest, done, start = dict(blocks), Counter(), 0
    for t, s in enumerate(slots):
        active = {x: weights[x] for x, n in rest.items() if n}
        done[s] += 1
        total = sum(active.values())
        if any(abs(done[x] - Fraction(t + 1 - start) * w / total) >= 1 for x, w in active.items()):
            return False
        if done[s] == rest[s]:
            for x in active:
                rest[x] -= done[x]
            done, start = Counter(), t + 1
    return not any(rest.values())


@pytest.mark.parametrize("sizes, weights", [
    ({"a": 1300, "b": 41, "c": 700, "d": 3}, {"a": 0.5, "b": 0.125, "c": 0.3, "d": 0.075}),
    ({"a": 400, "b": 40}, {"a": 0.5, "b": 0.5}),
    ({"a": 3000, "b": 900, "c": 2500}, {"a": 0.666, "b": 0.013, "c": 0.321}),
    ({"a": 800, "b": 800, "c": 801}, {"a": 1, "b": 1, "c": 1}),
])
def test_mix_stays_within_a_block_of_the_weights(spark, sizes, weights):
    rows = [(10_000 * k + i, f"t{i}", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, weights, block=4).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    slots = {r.slot: (r.source, r.block) for r in got}
    assert slots == scheduled(blocks, exact) and sorted(slots) == list(range(sum(blocks.values())))
    assert stays_near([slots[t][0] for t in range(len(slots))], blocks, exact)
    assert len({r.position for r in got}) == len(rows)
    assert Counter((r.source, r.block) for r in got).most_common(1)[0][1] == 4


def test_whole_shares():
    assert mixing.whole_shares({"a": 0.6666, "b": 0.3334}, 10_000) == {"a": 3333, "b": 1667}
    assert mixing.whole_shares({"a": 2, "b": 1, "c": 0}, 10_000) == {"a": 2, "b": 1}
    near = mixing.whole_shares({"a": 0.123456789, "b": 0.7, "c": 0.1}, 1000)
    assert sum(near.values()) == 1000 and abs(near["b"] - 1000 * 0.7 / 0.923456789) < 1
    assert mixing.whole_shares({}, 10) == {}


def test_sources_without_a_weight_get_a_block_a_cycle(spark):
    rows = [(i, "t", s) for i, s in enumerate(["a"] * 30 + ["b"] * 30 + [None] * 5)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 2, "b": 3}, block=1).collect()
    slots = {r.slot: (r.source, r.block) for r in got}
    assert slots == scheduled({"a": 30, "b": 30, "": 5}, {"a": 2, "b": 3, "": 1})


def test_mix_of_odd_rows(odd, none, docs):
    assert plain(mixing.mixed(odd).collect()) == plain(odd.collect())
    assert mixing.mixed(none).collect() == [] and mixing.mix(none).collect() == []
    positions = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    order = [r.doc_id for r in mixing.mixed(docs).collect()]
    assert order == sorted(order, key=positions.get)


def test_mix_is_native(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- the pipeline ---


def test_stages(spark, docs, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if k < 4:
            assert after.columns == docs.columns
            left = plain((r.doc_id, r.text) for r in after.collect())
        if k == 0:
            good = {r.doc_id for r in quality.quality(before).collect() if r.kept}
            assert left == plain(r for r in rows if r[0] in good) and len(left) < len(rows)
        elif k == 1:
            assert plain((i, sha(t)) for i, t in left) == plain((i, h) for i, _, _, h in deduped_lines(rows))
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif k == 2:
            assert {i for i, _ in left} == {c for _, c, _ in classes(rows)} and len(left) < len(rows)
        elif k == 3:
            assert left == plain(rows)
        else:
            assert after.count() == len(rows)
        before = after


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_and_no_rows(spark, request, sf, tmp_path, rows):
    before = request.getfixturevalue(rows)
    columns = before.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, before, sf).write.parquet(path)
        after, n = spark.read.parquet(path), before.count()
        assert k == 4 or after.columns == columns
        assert after.count() == n if k in (1, 3, 4) else after.count() <= n
        before = after
    assert (before.count() > 0) == (rows == "odd")


def test_the_mix_survives_many_files(spark, tmp_path):
    sizes = {"a": 3000, "b": 150, "c": 800}
    rows = [(1000 * k * k + i, f"text {i}", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, None, "b"), (None, "", "b"), (7, "text 7", "c")] + [(5, "again", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter((r.doc_id, r.slot, r.position) for r in mixing.mix(docs).collect())
    path = str(tmp_path / "mixed")
    mixing.mixed(docs).write.option("maxRecordsPerFile", 37).parquet(path)
    got = corpus_pipeline.bpe_tokens(spark, spark.read.parquet(path), "").collect()
    assert Counter((r.doc_id, r.slot, r.position) for r in got) == want
    assert len({r.position for r in got}) == len(rows)
    source = {(i, sha(t or "")): s for i, t, s in rows}
    in_order = [source[r.doc_id, r.decoded_sha256] for r in sorted(got, key=lambda r: r.position)]
    share = Counter(in_order[:500])  # the smallest source lasts for over 1000 rows
    assert all(abs(Counter(in_order[a : a + 500])[s] - n) < 50 for a in (250, 500) for s, n in share.items())


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
