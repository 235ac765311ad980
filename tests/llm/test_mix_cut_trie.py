"""Mixing, fill-in-middle and the prefix trie recomputed in plain Python, on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import fill_in_middle, mixing, prefix_trie
from tessella.llm.common import read_table

from .test_operators import DOCS, SF, awkward_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORDS.findall(text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Shares by weight; what is above twice a source's size goes to the others, again and again."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, excess, free = dict.fromkeys(keys, 0.0), share * sum(sizes.values()), set(keys)
    while excess > 1e-9 and free:
        total = sum(weight[k] for k in free)
        for k in free:
            target[k] += excess * weight[k] / total
        over = {k for k in free if target[k] > 2 * sizes[k]}
        excess = sum(target[k] - 2 * sizes[k] for k in over)
        target.update({k: 2.0 * sizes[k] for k in over})
        free -= over
    return target


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for source, n in (("a", 700), ("B", 40), ("", 25), (None, 60), ("é", 9), ("nothing", 3), ("😀", 30)):
        for _ in range(n):
            rows.append((at, None if source == "nothing" else "w " * rng.choice([0, 1, 5, 30, 200, 900]), source))
            at += 1
    return rows


def taken_by_source(rows):
    sums, targets = Counter(), {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sums[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    return sums, targets


def mixed_rows(df):
    return [{**r.asDict(), "source": r["row"]["source"], "taken": r["size"] * r["copies"]} for r in mixing.mixed(df).collect()]


def test_targets_by_brute_force_and_taken_words_near_them(spark, crowd):
    df = spark.createDataFrame(crowd, "doc_id long, text string, source string")
    got = mixed_rows(df)
    sizes = Counter()
    for _, text, source in crowd:
        sizes[source] += size(text)
    sums, targets = taken_by_source(got)
    want = brute_targets(sizes)
    for source, total in sizes.items():
        assert targets[source] == pytest.approx(want[source], rel=1e-9)
        assert 0 <= targets[source] - sums[source] <= max(0.02 * targets[source], 1)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixed_rows(df.repartition(7))
    assert Counter((r["row"]["doc_id"], r["taken"]) for r in again) == Counter((r["row"]["doc_id"], r["taken"]) for r in got)


def test_many_sources_are_dealt_out(spark, crowd, monkeypatch):
    df = spark.createDataFrame(crowd, "doc_id long, text string, source string")
    want = Counter((r["row"]["doc_id"], r["taken"]) for r in mixed_rows(df))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert Counter((r["row"]["doc_id"], r["taken"]) for r in mixed_rows(df)) == want


def test_a_source_of_equal_rows_is_taken_in_part(spark):
    df = spark.createDataFrame([(1, "one two three", "a")] * 400 + [(k, "w " * 50, "b") for k in range(100)], "doc_id long, text string, source string")
    sums, targets = taken_by_source(mixed_rows(df))
    assert targets["a"] == 2400 and sums["a"] == 2400
    df = spark.createDataFrame([(1, "one two three", "a")] * 400 + [(k, "w " * 5, "b") for k in range(10)] + [(k, "w " * 9, "c") for k in range(90)], "doc_id long, text string, source string")
    sums, targets = taken_by_source(mixed_rows(df))
    assert all(0 <= targets[s] - sums[s] < 9 for s in targets)


def test_larger_budgets_hold_smaller_ones(spark):
    df = spark.createDataFrame([(k, "w " * (1 + k % 7), "a") for k in range(500)] + [(k, "w", "b") for k in range(500, 900)], "doc_id long, text string, source string")
    chosen = [{r["row"]["doc_id"] for r in mixing.mixed(df, share=share, near=0.05).collect() if r["copies"]} for share in (0.3, 0.6, 0.9)]
    assert chosen[0] < chosen[1] < chosen[2]


def test_mix_of_awkward_rows(docs, empty):
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert not {r["doc_id"] for r in got.collect()} & {0, 1, 2}
    assert mixing.mixed(docs).count() == docs.count() and mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


# fill-in-middle


def brute_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


AWKWARD = ["", "a", "é", "😀", "a<P>b", "<S", "S>", "<", "<<S", "M>x<", "́e", "\x00\x01", "tab\tnew\nline", "中" * 5000 + "a" * 5000, "ab é" * 3000]


def test_cuts_by_brute_force(spark):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(AWKWARD * 20 + [None])]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in fill_in_middle.digests(made).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((d, *(c := brute_cut(d, t))[:4], sha(c[4]), sha(t or "")) for d, t in rows)
    assert got == want
    whole = fill_in_middle.transform(made)
    assert whole.columns == ["doc_id", "text"]
    assert Counter(tuple(r) for r in whole.collect()) == Counter((d, brute_cut(d, t)[4]) for d, t in rows)


@pytest.mark.parametrize("units", ["chars", "words"])
def test_every_boundary_is_found_exactly(units, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "STRETCH", 1000)
    rng = random.Random(8)
    texts = [t for t in AWKWARD] + ["".join(rng.choice(["a", "é", "€", "😀", " ", "\n", "word "]) * rng.choice([1, 1, 40]) for _ in range(2000)), "a" * 99_999, "  lead", " \n "]
    for text in texts:
        data = text.encode()
        index = fill_in_middle.RankIndex(data, units)
        if units == "chars":
            want = list(itertools.accumulate([0, *(len(c.encode()) for c in text)]))
        else:
            want = [len(text[: m.start()].encode()) for m in re.finditer(r"[^ \t-\r]+", text)] + [len(data)]
            if text and want[0] > 0:
                want = [0, *want]
        assert index.n == len(want) - 1
        assert [index.offset(k) for k in range(index.n + 1)] == want
        assert index.residual.dtype == np.int8


def test_segments_are_long_and_hold_their_error():
    offsets = np.cumsum(np.random.default_rng(2).choice([1, 2], 20_000, p=[0.8, 0.2]))
    first, base, slope = fill_in_middle.fit(offsets, 32)
    assert len(first) < 60  # a line through steady text runs on
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(offsets))))
    assert np.abs(base[owner] + slope[owner] * (np.arange(len(offsets)) - first[owner]) - offsets).max() <= 32
    assert len(fill_in_middle.fit(np.arange(10**6), 1)[0]) == 1


def test_index_table_and_word_cuts(docs, empty):
    made = {r["doc_id"]: r for r in fill_in_middle.rank_index(docs, "words").collect()}
    assert made[5]["n"] == 80 and len(made[5]["residuals"]) == 81
    text = dict(awkward_rows_by_id())[7]
    for r in fill_in_middle.transform(docs.where("doc_id = 7"), "words").collect():
        assert Counter(WORDS.findall(re.sub("<[PSM]>", " ", r["text"]))) == Counter(WORDS.findall(text))
    assert fill_in_middle.transform(docs).columns == docs.columns
    assert fill_in_middle.digests(docs).count() == docs.count()
    for f in (fill_in_middle.transform, fill_in_middle.digests, fill_in_middle.rank_index):
        assert f(empty).count() == 0


def awkward_rows_by_id():
    return [(r[0], r[1]) for r in awkward_rows()]


# the prefix trie


def brute_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
        ends[tuple(own[c])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * size(k[-1][1] if k else "")
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    texts = ["hello", "hello there you", "", None, "one two\tthree\nfour", "é 😀 ü"]
    rows = []
    for c in range(130):
        if c % 20 == 0 and c % 40:
            continue  # a family without its first conversation
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(500, k, "user", "same") for k in range(40)] + [(501, k, "user", "same") for k in range(40)] + [(520, k, "user", f"t{k}") for k in range(33)]
    return rows + rows[:3] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("band, block", [(2048, 1 << 14), (3, 1 << 14), (2, 4), (2048, 5)])
def test_trie_by_brute_force(spark, talks, monkeypatch, band, block):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    df = spark.createDataFrame(talks, TURNS)
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(*prefix_trie.ordered(df)))
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == brute_trie(talks)
    if block == 5:
        monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
        assert Counter(tuple(r) for r in prefix_trie.trie(df).select(*COLUMNS).collect()) == brute_trie(talks, False)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in prefix_trie.query(spark, SF).select(*COLUMNS).collect()) == brute_trie(rows)


def test_empty_and_turnless_tries(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, 1, "user", "x") for c in range(41, 60)]  # no first conversation: those that take over more than they have are turnless
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(*prefix_trie.ordered(spark.createDataFrame(rows, TURNS))))
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == brute_trie(rows)


def test_slots_are_minimal_perfect_and_verified():
    keys = np.random.default_rng(1).integers(0, 2**63, (50_000, 2)).astype(np.uint64)
    table = prefix_trie.PerfectHash(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    assert prefix_trie.PerfectHash(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(np.repeat(keys[:1], 2, axis=0))
