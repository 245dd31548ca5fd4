"""Suffix-array dedup against all substrings."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from kvlog.llm import suffix_dedup
from kvlog.llm.shared import in_bitmap


def brute(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    count = collections.Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde ") for _ in range(1500)) for _ in range(3)]
    docs = list(enumerate(base))
    for i in range(30):
        b = r.choice(base)
        a, n = r.randrange(1000), r.randrange(200, 900)
        x = list(b[a : a + n])
        for _ in range(r.choice([0, 0, 1, 2])):
            x[r.randrange(len(x))] = "Z"
        docs.append((10 + i, "".join(r.choice("xyzé") for _ in range(r.randrange(300))) + "".join(x) + "".join(r.choice("uvw") for _ in range(r.randrange(200)))))
    return docs + [(100, None), (101, ""), (102, "ab" * 900), (103, "a" * 1000), (104, "q"), (None, base[0][:500]), (12, docs[12][1])]


@pytest.mark.parametrize(("length", "seed", "windows"), [(400, 1, 1 << 21), (400, 2, 64), (100, 3, 1 << 21)])
def test_repeats(spark, length, seed, windows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_bytes string").repartition(4)
    got = suffix_dedup.remove_repeats(df, length)
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept_bytes"])) for x in got.collect()), key=repr) == brute(docs, length)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = suffix_dedup.remove_repeats(df, 400)
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept_bytes"])) for x in got.collect()), key=repr) == brute(docs, 400)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_many_reaches_beside_one_passage(spark, monkeypatch):
    """Where very many documents leave a shared passage in their own ways, no group of bytes beyond GROUP meets in one task."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 8)
    sizes, large_of = [], suffix_dedup._large

    def spy(beside):
        large = large_of(beside)
        keys = np.array([r["key"] for r in beside.select("key").collect()], np.int64)
        on = in_bitmap(large.value, keys)
        sizes.append((max(collections.Counter(keys[~on].tolist()).values(), default=0), int(on.sum())))
        return large

    monkeypatch.setattr(suffix_dedup, "_large", spy)
    r = random.Random(6)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, ways = some(900), [some(150) for _ in range(3)]
    docs = corpus(5) + [(200 + i, some(r.randrange(300)) + passage + r.choice(["", *ways]) + some(r.randrange(300))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, 400)
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept_bytes"])) for x in got.collect()), key=repr) == brute(docs, 400)
    ((few, many),) = sizes
    assert 0 < few <= 8 and many > 100


def test_levels_grow_geometrically(spark):
    index = suffix_dedup.SuffixIndex(spark)
    met = []
    for i in range(5):
        batch = spark.createDataFrame([(k, k * 10 + i * (k == 2)) for k in (i, i + 1)], "seed long, reach long")
        met.append(sorted((r["seed"], r["mixed"]) for r in index.add(batch).collect()))
    assert [size for size, _ in index.levels] == [4, 1]
    assert met == [[], [(1, False)], [(2, True)], [(3, False)], [(4, False)]]


def test_runs_that_tasks_part():
    """Entries in order, dealt over tasks at every place: the rows put together say which seeds met."""
    r = random.Random(8)
    entries = sorted({(s, r.randrange(50)): (r.randrange(1, 3), r.randrange(2)) for s in [*range(12), 5, 5, 5] for _ in range(r.randrange(1, 3))}.items())
    rows = [(s, reach, n, new) for (s, reach), (n, new) in entries]
    wanted = {}
    for s, reach, n, new in rows:
        have = wanted.setdefault(s, [0, 0, set()])
        have[0], have[1] = have[0] + n, max(have[1], new)
        have[2].add(reach)
    wanted = {(s, len(reaches) > 1) for s, (n, new, reaches) in wanted.items() if n > 1 and new}
    for tasks in range(1, len(rows) + 1):
        for size in (1, 3, 100):
            out = []
            for t in range(tasks):
                own = rows[t * len(rows) // tasks : (t + 1) * len(rows) // tasks]
                batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in own[i : i + size]], pa.int64()) for c in range(4)], ["seed", "reach", "n", "new"]) for i in range(0, len(own), size)]
                out += [x for b in suffix_dedup._runs_of(iter(batches)) for x in b.to_pylist()]
            by = {}
            for x in out:
                have = by.setdefault(x["seed"], [0, 0, x["least"], x["most"]])
                have[:] = have[0] + x["n"], max(have[1], x["new"]), min(have[2], x["least"]), max(have[3], x["most"])
            assert {(s, a != b) for s, (n, new, a, b) in by.items() if n > 1 and new} == wanted


def test_later_batches(spark, tmp_path):
    """Documents added to an index that is opened again lose what earlier batches hold."""
    docs = corpus(9)
    batches = [docs[:12], docs[12:25], docs[25:]]
    for k, batch in enumerate(batches):
        index = suffix_dedup.SuffixIndex(spark, f"file://{tmp_path}/index")
        assert [size for size, _ in index.levels] == [[], [1], [2]][k]
        df = spark.createDataFrame(batch, "doc_id long, text string").repartition(2)
        got = suffix_dedup.add_documents(index, df)
        upto = [d for b in batches[: k + 1] for d in b]
        wanted = [x for x in brute(upto, 400) if x[0] in {d for d, _ in batch}]
        mine = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept_bytes"])) for x in got.collect()), key=repr)
        assert [x for x in mine if x[0] != 12] == [x for x in wanted if x[0] != 12]  # 12 is an id of two batches


def test_passages_of_words(spark):
    """51 words in a row in another document, whatever their length; fewer than 32 are none, nor is a row repeated in full."""
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randrange(1, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    docs, wanted = [], {}
    for n in (51, 52, 70, 300, 31, 20):
        passage = some(n)
        for _ in range(2):
            wanted[len(docs)] = n > 50
            docs.append((len(docs), f"{some(r.randrange(90))}\n{passage}\n{some(r.randrange(90))}"))
    docs += [(100, some(200)), (101, None), (102, "")]
    docs += [docs[-3]]
    wanted |= {100: False, 101: False, 102: False}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, 400).collect()
    assert len(got) == len(docs) and {x["doc_id"]: x["has_repeats"] for x in got} == wanted


def test_least_of_windows():
    r = np.random.default_rng(1)
    for n, w in ((10, 3), (11, 11), (500, 64), (65, 64)):
        x = r.integers(0, 50, n).astype(np.uint64)
        assert suffix_dedup._least(x, w).tolist() == [int(x[i : i + w].min()) for i in range(n - w + 1)]
