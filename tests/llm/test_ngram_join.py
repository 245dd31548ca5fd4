"""The n-gram join and its components against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kvlog.llm import ngram_join
from kvlog.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, n, percent):
    sets = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append((d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(x), least[find(i)]) for i, (d, x) in enumerate(sets))


def corpus(seed, size):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(3, 150))] for _ in range(6)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    docs = []
    for i in range(size):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.4:
            words += passage
        if r.random() < 0.3:
            words = words[r.randrange(3) :]
        text = r.choice([" ", "\n"]).join(words)
        docs.append((i, text.upper() if r.random() < 0.2 else text))
    return docs + [(size, None), (size + 1, ""), (size + 2, " \t"), (size + 3, "one"), (size + 4, "ONE"), (size + 5, "one two")]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components(spark, n, percent, monkeypatch):
    docs = corpus(n, 160)
    docs += docs[:3]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, component_id string").repartition(4)
    got = ngram_join.jaccard_components(df, n, percent)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, n, percent)


def test_prefixes_of_every_size_can_be_extended():
    """Also where all tokens of a set are frequent and in one group; sets too small to have partners are given none."""
    for percent in range(50, 101):
        for size in range(1, 300):
            tokens = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(1 << 20)
            if 100 * size >= percent * (size + 1):
                for level, tau in ngram_join.levels(size, percent):
                    assert len(ngram_join.signatures(tokens, np.full(size, 9), 1.0, level, tau))


def test_frequent_short_texts(spark, monkeypatch):
    """Short texts that share most of their words with very many others, all of them frequent."""
    monkeypatch.setattr(ngram_join, "_threshold", lambda sketch: 0.0)
    r = random.Random(12)
    base = [[f"w{i}" for i in range(k, k + 12)] for k in (0, 5, 40)]
    docs = []
    for i in range(150):
        words = list(r.choice(base))[: r.randrange(2, 13)]
        if r.random() < 0.5:
            words[r.randrange(len(words))] = f"x{r.randrange(3)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for n, percent in ((1, 75),):
        assert sorted(tuple(x) for x in ngram_join.jaccard_components(df, n, percent).collect()) == brute(docs, n, percent)


def test_sets_that_meet_in_their_name(monkeypatch):
    """Names of four bits only: different sets meet, and are told apart by the other half."""
    docs = [(i, f"a{i % 7} b c d{i % 5} e") for i in range(60)]
    sum_hash = ngram_join._sum_hash

    def short(tokens, salt):
        h = sum_hash(tokens, salt)
        return h & np.uint64(15) if salt == 0x5851F42D4C957F2D else h

    monkeypatch.setattr(ngram_join, "_sum_hash", short)
    sketch = np.zeros(1 << ngram_join.SLOT_BITS, np.int32)
    rows = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["row_id", "text"])
    met = frozenset()
    for _ in range(20):
        got = [x for b in ngram_join._cards(iter([rows]), "text", 2, 80, sketch, met) for x in b.to_pylist()]
        by = {}
        for x in got:
            by.setdefault(x["set"], set()).add(x["more"])
        new = {k for k, more in by.items() if len(more) > 1}
        if not new:
            break
        met |= new
    assert met and len(by) == len({(i % 7, i % 5) for i in range(60)})


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 16)
    monkeypatch.setattr(ngram_join, "_threshold", lambda sketch: 8.0)
    docs = corpus(9, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(df, 4, 85).collect()) == brute(docs, 4, 85)


def test_pairs_below_the_threshold_stay_in_the_list(monkeypatch):
    """Sets of one template that differ a little more than allowed (0.78 and 0.79 against 0.8), and some that don't."""
    monkeypatch.setattr(ngram_join, "PAIRS", 10)
    r = np.random.default_rng(4)
    some = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    for common in (525, 530):
        shared = some(common)
        sets = [np.unique(np.concatenate([shared, some(600 - common)])) for _ in range(60)]
        sets += [np.unique(np.concatenate([x[:-20], some(20)])) for x in sets[:8]]
        level = 600 .bit_length()
        wide = [ngram_join.wide_parity(x, level) for x in sets]
        assert all(w == len(ngram_join.parity(x, level)) for (w, _), x in zip(wide, sets, strict=True))
        columns = [[7] * len(sets), [0] * len(sets), range(len(sets)), map(len, sets), (ngram_join.parity(x, level) for x in sets), range(len(sets)), (w for _, w in wide)]
        rows = pa.RecordBatch.from_arrays([pa.array([*c]) for c in columns], ["list", "part", "set", "size", "bits", "root", "wide"])
        out = [*ngram_join._candidates(iter([rows]), 80, True)]
        assert all(b.num_rows <= 10 for b in out)
        got = {p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)}
        assert linked and linked <= got
        assert len(got - linked) < 0.1 * len(sets) ** 2 / 2


def test_empty_table_and_one_of_each_group(spark):
    df = spark.createDataFrame(corpus(1, 60), "doc_id long, text string")
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0
    kept = {r["doc_id"] for r in ngram_join.keep_one(df, 4, 85).collect()}
    assert kept == {d for d, _, c in brute(corpus(1, 60), 4, 85) if d == c}


def test_sets_that_reach_the_threshold_share_a_signature():
    r = np.random.default_rng(3)
    for percent in (50, 80, 85, 100):
        for _ in range(300):
            size = int(r.integers(1, 300))
            x = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
            y = np.unique(np.concatenate([x[r.random(len(x)) > r.random() * 0.3], r.integers(0, 1 << 63, int(r.integers(0, 40))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or (len(x) == len(y) == both) or 100 * both < percent * (len(x) + len(y) - both):
                continue
            found = []
            for tokens in (x, y):
                counts = (tokens % np.uint64(7)).astype(np.int64)
                order = np.lexsort((tokens, counts))
                found.append({int(h) for level, tau in ngram_join.levels(len(tokens), percent) for h in ngram_join.signatures(tokens[order], counts[order], 2.0, level, tau)})
            assert found[0] & found[1]


def test_graph_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for u, v in edges:
        if u != v:
            a, b = root.setdefault(u, {u}), root.setdefault(v, {v})
            if a is not b:
                a |= b
                for x in b:
                    root[x] = a
    assert got == {x: min(g) for x, g in root.items()}
