"""WARC archives and chat packs, written and read back."""

import base64
import hashlib
import struct
import urllib.parse

import pyarrow.fs as pafs
import zstandard

from kvlog.llm import chat_tree, queries, warc


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://x.example/{i}", f"<html>{'é' * (i % 5)} page {i % 7}</html>") for i in range(40)]
    pages += [(100, None, None), (101, "http://a\r\nb", ""), (7, pages[7][1], pages[7][2]), (102, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    manifest = warc.write_archives(df, f"file://{tmp_path}/warc")
    got = sorted(warc.read_archives(manifest).collect(), key=lambda r: r["page_id"])
    assert len(got) == len(pages) == sum(r["n_records"] for r in manifest.collect())
    last = {}
    for i, _, html in pages:
        last[html or ""] = max(last.get(html or "", i), i)
    for r, (i, url, html) in zip(got, sorted(pages, key=lambda p: p[0]), strict=True):
        raw = (html or "").encode()
        assert (r["page_id"], r["payload_bytes"], r["payload_digest"]) == (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[html or ""] == i else ("revisit", last[html or ""]))
        assert r["payload"] == ((html or "") if r["record_type"] == "response" else None)
        assert (r["url"] or "") == ("http://a%0D%0Ab" if i == 101 else url or "")
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    urllib.parse.urlparse(got[0]["url"])


def test_smaller_payloads_are_no_revisits(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long one"), (4, "d", "long one")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(df, min_bytes=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_dictionary_frame_and_single_records(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<html><body>Hello number {i}</body></html>" * 20) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df, f"file://{tmp_path}/w").first()["path"]
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        raw = f.read()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    own = raw[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if own[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=kind)).decompressobj()
    first = one.decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n") and first.count(b"WARC/1.1\r\n") == 1 and one.unused_data[:4] == b"\x28\xb5\x2f\xfd"


def digests(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join("".join(chat_tree.format_turn(r, x)) for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(whole))
    return out


CHATS = (
    [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c // (2 ** (3 - min(t, 3)))}" + "é\\<|>" * (t % 3)) for c in range(16) for t in range(5)]
    + [(20 + i, t, r, x) for i in range(6) for t, r, x in [(0, "system", "same"), (1, "user", "same"), (2, "assistant", "same")]]
    + [(-7, 0, "user", queries.CONTROL[1]), (-7, 1, "assistant", queries.CONTROL[1]), (50, 0, None, None), (51, 0, "assistant", ""), (52, 3, "a>b\\", "</turn>\n<turn x>"), (53, 1, "user", "b"), (53, 1, "user", "a"), (53, 1, "user", "a"), (54, 0, "assistant", "long " * 30_000)]
)


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(4)
    for limit in (chat_tree.MAX_TOKENS, 60):
        packs = chat_tree.packs(df, max_tokens=limit)
        rows = chat_tree.read_packs(packs).collect()
        assert {r["conv_id"]: tuple(r)[1:] for r in rows} == digests(CHATS) and len(rows) == len(digests(CHATS))
        assert max(len(p["tokens"]) for p in packs.collect()) <= limit
    assert chat_tree.packs(df.limit(0)).count() == 0


def test_long_conversations_and_rows_without_id(spark, monkeypatch):
    """A conversation of very many turns is cut where tasks part and put together again; rows without id are conversations of their own."""
    monkeypatch.setattr(chat_tree, "TURNS", 16)
    long = [(1, t, ("user", "assistant")[t % 2], f"turn {t} <{t}>") for t in range(400)]
    lone = [(None, 0, "assistant", "alone"), (None, 0, "assistant", "alone"), (None, None, None, None), (None, 3, "assistant", "<|" * 500)]
    df = spark.createDataFrame(long + lone, "conv_id long, turn long, role string, text string").repartition(4)
    wanted = [(1, *digests(long)[1]), *((None, *digests([(0, x[1] or 0, *x[2:])])[0]) for x in lone)]
    for limit in (chat_tree.MAX_TOKENS, 100):
        packs = chat_tree.packs(df, max_tokens=limit)
        assert sorted(map(tuple, chat_tree.read_packs(packs).collect()), key=repr) == sorted(wanted, key=repr)


def test_packs_share_turns_and_say_what_is_seen(spark):
    df = spark.createDataFrame([x for x in CHATS if 0 <= x[0] < 30], "conv_id long, turn long, role string, text string").coalesce(1)
    packs = chat_tree.packs(df).collect()
    nodes = sum(len(p["nodes"]) for p in packs)
    assert nodes <= len({(c, t) for c, t, _, _ in CHATS if 0 <= c < 30}) - 20
    for p in packs:
        for node in p["nodes"]:
            path, at = [], node["parent"]
            while at >= 0:
                path.append(at)
                at = p["nodes"][at]["parent"]
            seen = sorted(i for q in path for i in range(p["nodes"][q]["start"], p["nodes"][q]["end"]))
            assert seen == [i for a in node["ancestors"] for i in range(a["start"], a["end"])]
            assert p["positions"][node["start"] : node["end"]] == list(range(len(seen), len(seen) + node["end"] - node["start"]))
        assert len(p["tokens"]) == len(p["positions"]) == p["nodes"][-1]["end"]
