"""The pipeline as it is wired, against plain Python, and its stages on odd tables."""

import random

import pytest
from pyspark.sql import functions as F
from test_lines_and_quality import lines_of, rules_of
from test_ngram_join import brute as joined
from test_texts import edit_distance

import corpus_pipeline
from kvlog.llm import decontamination

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "kept", "id", "gone", "hash", "row", "component_id"]


def corpus():
    """Prose with common lines, near and exact copies, benchmark passages (one with edits), and junk of several kinds."""
    r = random.Random(21)
    syllables = ["an", "the", "ing", "er", "on", "re", "st", "ed", "ly", "wh", "or", "ble", "sh", "in", "of", "th", "and", "ent", "al", "ou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    line = lambda n=25: " ".join(word() for _ in range(n))
    items = [line(20) for _ in range(4)]
    common = [line(12), line(9)]
    texts = []
    for i in range(60):
        lines = [line() for _ in range(r.randrange(4, 9))]
        if i % 3 == 0:
            lines.insert(2, common[0].upper() if i % 2 else f"  {common[0]}")
        if i % 4 == 1:
            lines.append(common[1])
        if i in (7, 8):
            lines[1] += " " + items[i - 7]
        if i == 9:
            lines[1] += " " + items[2].replace("a", "b", 2)
        texts.append("\n".join(lines))
    near = texts[11].split(" ")
    near[4] = "changed"
    texts += [texts[10], " ".join(near), texts[12] + "\n" + common[0], "spam " * 200, "few words", line(100).replace(" ", "%%% "), None, "", " \n"]
    docs = [(i, t, "en", "s", len(t or ""), "mine", i, f"id{i}", None, 1.5, "r", -1) for i, t in enumerate(texts)]
    return docs + [docs[5]], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, kept long, id string, gone string, hash double, row string, component_id long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain():
    docs, items = corpus()
    rest = {d[0]: d[2:] for d in docs}
    now = [d[:2] for d in docs if rules_of(d[1])[-1]]
    assert 55 < len(now) < len(docs) - 5
    now = [(d, t) for d, _, _, t in lines_of(now, 10)]
    gone = {d for d, _, c in joined(now, 5, 80) if d != c}
    assert len(gone) == 3
    now = [(d, t) for d, t in now if d not in gone]
    held = lambda t: any(edit_distance(decontamination.normalise(i), decontamination.normalise(t)) <= len(decontamination.normalise(i)) // decontamination.CHARS_PER_EDIT for i in items)
    clean = [(d, t) for d, t in now if not held(t)]
    assert len(now) - len(clean) == 3
    return sorted(((d, t, *rest[d][:2], len(t), *rest[d][3:]) for d, t in clean), key=repr)


def test_run_against_plain_python(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert out.columns[: len(NAMES)] == NAMES and all(r["decoded"] == r["text"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert sorted((tuple(r)[: len(NAMES)] for r in rows), key=repr) == plain()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, folder, name):
    """Nulls in every column, one row, no rows, repeated rows: no crash, and the columns of documents but for the last stage."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nulls = docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    for some in (docs.limit(0), nulls, nulls.unionAll(nulls), docs.where("doc_id = 20").unionAll(nulls)):
        out = stage(spark, some, folder)
        assert out.columns[: len(NAMES)] == NAMES and (name == "sentencepiece" or out.columns == NAMES)
        got = out.collect()
        alone = 0 if name == "quality_rules" else some.where("doc_id IS NULL").count()
        assert len(got) == some.where("doc_id IS NOT NULL").count() + alone
    only = docs.where("doc_id < 3").select("doc_id", "text")
    assert stage(spark, only, folder).columns[:2] == ["doc_id", "text"]
