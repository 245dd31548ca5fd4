"""Line dedup and quality rules against plain Python."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import zstandard

from kvlog.llm import line_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64))
    for some in (keys, keys[:1], keys[:0]):
        h = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(some).dump())
        assert sorted(h.index(some).tolist()) == list(range(len(some))) and h.size == len(some)
    assert (line_dedup.PerfectHash.build(keys).index(keys + np.uint64(1)) < len(keys)).all()


def lines_of(docs, min_docs, min_chars=1):
    key = lambda line: line.strip(SPACE).translate(FOLD)
    df = collections.Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < min_chars or df[key(x)] < min_docs]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [1, 3])
def test_line_dedup(spark, min_docs):
    r = random.Random(2)
    pool = ["", " ", "Common\t", "common", "ÀB c", "àB c", "x\r", " y", "long " * 50, "é"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(30)]
    docs += [(40, None), (41, ""), (None, "common\nown line"), (5, docs[5][1]), (42, "\n"), (43, "z" * 200_000 + "\ncommon")]
    df = spark.createDataFrame([(d, t, "n", "l") for d, t in docs], "doc_id long, text string, n_lines string, lang string").repartition(3)
    got = line_dedup.drop_common_lines(df, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    assert sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in got.collect()), key=repr) == lines_of(docs, min_docs)
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0


def test_a_hot_line_is_spread(spark, monkeypatch):
    """Many shards, one line in a third of all documents: its shard is copied, and no copy gets much more than its share."""
    docs = [(i, f"own {i}\nother {i}" + "\nhot" * (i % 3 == 0)) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen = []
    salted = line_dedup._salted

    def watch(shards, probes, copies):
        out = salted(shards, probes, copies)
        seen.append((copies, max(r["count"] for r in out[1].groupBy("shard", "salt").count().collect()), shards.count()))
        return out

    monkeypatch.setattr(line_dedup, "_salted", watch)
    got = line_dedup.drop_common_lines(df, 10, shard_keys=64, probes_each=128).collect()
    assert sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in got) == sorted(lines_of(docs, 10))
    copies, most, shards = seen[0]
    assert shards > 40 and len(copies) == 1 and copies[0][1] >= 4 and most <= 1.5 * 128


def test_line_dedup_keeps_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", "y", 7)], "doc_id long, text string, id string, gone string, __id int")
    got = line_dedup.drop_common_lines(df, 2).first()
    assert (got["id"], got["gone"], got["__id"], got["text"]) == ("x", "y", 7, "a\nb")


def rules_of(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if grams[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    raw = text.encode()
    c = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False)
    ok = True
    for start, lo, hi in reversed(quality_rules.BANDS):
        if len(raw) >= start:
            ok = lo <= len(raw) / len(c.compress(raw)) <= hi
            break
    for width, lo, hi in quality_rules.CHUNK_BANDS:
        for i in {*range(0, len(raw) - width, width), len(raw) - width} if len(raw) >= width else ():
            ok = ok and lo <= width / len(c.compress(raw[i : i + width])) <= hi
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), dup, len(covered), failed, not failed and ok


def test_quality_rules(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "été", "naïve", "a|b", "<x>", "ß", "river", "stone", "cloud", "42", " "]
    texts = [None, "", " \n\t", "one", "a b c a b c", "spam " * 400, "word\n" * 60, "".join(r.choice("abcdefghijklmnop0123456789+/") for _ in range(9000)), "x" * 300_000]
    texts += [" ".join(r.choice(vocabulary) + str(r.randrange(k)) for _ in range(r.randrange(20, 2500))) for k in (3, 50, 10_000) for _ in range(6)]
    texts += ["line one here\nline two here\nline one here\n \n \n" + texts[-1], texts[-1] + " repeat this passage" * 500 + texts[-2]]
    syllables = ["an", "the", "ing", "er", "on", "re", "st", "ed", "ly", "wh", "or", "ble", "sh", "in", "of", "th", "and", "ent", "al", "ou"]
    texts += [" ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(n)) for n in (60, 300, 2000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "one", "x")], "doc_id long, text string, Kept string").repartition(3)
    out = quality_rules.quality_rules(df)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = {x["doc_id"]: tuple(x[n] for n in names) for x in out.collect()}
    assert got == {i: rules_of(t) for i, t in enumerate(texts)}
    assert len({v[-1] for v in got.values()}) == 2
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, v in got.items() if v[-1]}
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_base64_and_repeated_passages():
    r = random.Random(5)
    c = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False)
    for n in (256, 1000, 4600, 9000, 20_000, 81_000):
        code = base64.b64encode(r.randbytes(n)).decode()
        assert not quality_rules.compression("\n".join(code[i : i + 76] for i in range(0, n, 76)).encode()[:n], c)[2], n
    syllables = ["an", "the", "ing", "er", "on", "re", "st", "ed", "ly", "wh", "or", "ble", "sh", "in", "of", "th", "and", "ent", "al", "ou"]
    plain = " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(3000)).encode()
    code = base64.b64encode(r.randbytes(4000))
    for n in (900, 4096, 9000):
        assert quality_rules.compression(plain[:n], c)[2], n
        for m in (1024, 2500, 4000):
            assert not quality_rules.compression(plain[:n] + (b" repeat this passage" * 200)[:m], c)[2], (n, m)
            assert not quality_rules.compression(plain[:n] + code[:m], c)[2], (n, m)


def test_only_the_bands_catch(spark):
    """Texts that pass the word rules: trailing symbols on each word, a table of repeated columns, base64 words; plain ones of the same lengths stay."""
    r = random.Random(6)
    syllables = ["an", "the", "ing", "er", "on", "re", "st", "ed", "ly", "wh", "or", "ble", "sh", "in", "of", "th", "and", "ent", "al", "ou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    docs = []
    for n in (200, 700, 3000):
        docs += [(len(docs), " ".join(word() for _ in range(n)), True)]
        docs += [(len(docs), " ".join(word() + r.choice("%$*&#") * 3 for _ in range(n)), False)]
        docs += [(len(docs), " ".join(f"{word()}{i} status=open;owner=none" for i in range(n)), False)]
        docs += [(len(docs), " ".join(base64.b64encode(r.randbytes(9)).decode() for _ in range(n)), False)]
    got = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, good boolean")).collect()
    assert not any(x["base_failed"] for x in got)
    assert [x["doc_id"] for x in got if x["kept"] != x["good"]] == []


def test_digest_of_kept_text(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert hashlib.sha256(line_dedup.drop_common_lines(df, 2).first()["text"].encode()).hexdigest() == hashlib.sha256(b"a\nb").hexdigest()
