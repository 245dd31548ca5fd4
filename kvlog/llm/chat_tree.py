r"""Chat formatting as prefix trees.

A turn is written ``<turn ROLE>TEXT</turn>`` and a line break; backslash, ``<`` and
``>`` inside roles and texts get a backslash before them, so no text can hold a
control string and reading gives roles and texts back. Conversations that share
initial turns share these turns' nodes. A pack is one training sequence: the
trees of some conversations, depth first, each node's tokens once, with position
ids that go on from the parent's (as if its conversation stood alone), the loss
mask (the texts of assistant turns) and, for each node, the intervals of tokens
that its ancestors take up: a token attends to these and to its own node before it.

Turns stay rows. Those of a conversation are numbered in order, conversations are
range-partitioned and sorted by their path (hashes of their first ``PATH`` turns) and
id: the depth-first order of the trie. A task streams the turns, merges them one by one
with the path it has open and holds one piece and one pack. Packs end at ``max_tokens``
tokens, which are counted, not estimated, or ``MAX_MEMBERS`` conversations: a first turn,
or a whole conversation, in a third of all rows is spread over packs and tasks, and each
pack repeats its open path. Hashes only order; turns are merged if they are equal.

A conversation that fits no pack is cut into pieces that do, between turns or inside a
long text, and so is one of more than ``TURNS`` turns where tasks part. A piece is a
member of a pack like a conversation, with the turn and slice that it starts with; its
positions start again. Readers put pieces together by these, streaming.

Defined cases: null roles and texts are empty; turns of one number are ordered by
role, then text, and repeated rows stay; a conversation with one turn is a tree of
one node; a row without conversation id is a conversation by itself; roles aren't cut,
so one as long as a pack makes a longer pack; an empty table gives no packs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's merges expect texts to be split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_TOKENS = 1 << 15
MAX_MEMBERS = 1 << 12
#: Turns whose hashes order conversations, and turns of one that stay in one task.
PATH = 64
TURNS = 4096
LEARNED = "assistant"
_SPAN = "array<struct<start:int,end:int>>"
PACK = f"tokens array<int>, positions array<int>, loss {_SPAN}, nodes array<struct<parent:int,start:int,end:int,ancestors:{_SPAN}>>, members array<struct<chain:string,conv_id:long,leaf:int,turn:long,slice:int,whole:boolean>>"
_TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>([^\\<>]*(?:\\.[^\\<>]*)*)</turn>\n", re.DOTALL)


def escape(s: str) -> str:
    return re.sub(r"[\\<>]", r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\([\\<>])", r"\1", s)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    return f"<turn {escape(role)}>", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        if (m := _TURN.match(formatted, at)) is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def encoding(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("kvlog", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Segment(NamedTuple):
    """A turn, or a slice of one: what is written, its tokens, and where the text to be learned is in them. Segments are equal if text and place are."""

    text: str
    tokens: list[int]
    loss: tuple[int, int] | None


def segments(role: str, text: str, width: int) -> Iterator[tuple[str, str, str, bool]]:
    """(head, body, tail, whether the body is learned) of each slice of a turn; the head is in the first, the tail in the last."""
    head, _, tail = format_turn(role, "")
    cuts = range(0, max(1, len(text)), width)
    for at in cuts:
        yield head if not at else "", escape(text[at : at + width]), tail if at == cuts[-1] else "", role == LEARNED


class Pack:
    def __init__(self) -> None:
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.loss: list[tuple[int, int]] = []
        self.nodes: list[dict] = []
        self.members: list[dict] = []
        self.open: list[tuple[Segment, int, int]] = []  # segment, node, position behind it

    def shared(self, piece: list[Segment]) -> int:
        n = 0
        while n < min(len(piece), len(self.open)) and self.open[n][0][::2] == piece[n][::2]:
            n += 1
        return n

    def add(self, piece: list[Segment], member: dict) -> None:
        del self.open[self.shared(piece) :]
        for segment in piece[len(self.open) :]:
            parent, position = (self.open[-1][1], self.open[-1][2]) if self.open else (-1, 0)
            start = len(self.tokens)
            end = start + len(segment.tokens)
            self.tokens.extend(segment.tokens)
            if segment.loss:
                self.loss.append((start + segment.loss[0], start + segment.loss[1]))
            before: list[tuple[int, int]] = []
            if parent >= 0:
                up = self.nodes[parent]
                before = [*up["ancestors"]]
                if before and before[-1][1] == up["start"]:
                    before[-1] = (before[-1][0], up["end"])
                else:
                    before.append((up["start"], up["end"]))
            self.positions.extend(range(position, position + end - start))
            self.nodes.append({"parent": parent, "start": start, "end": end, "ancestors": before})
            self.open.append((segment, len(self.nodes) - 1, position + end - start))
        self.members.append(member | {"leaf": self.open[-1][1]})

    def row(self) -> dict:
        spans = lambda pairs: [{"start": a, "end": b} for a, b in pairs]
        return {"tokens": self.tokens, "positions": self.positions, "loss": spans(self.loss), "nodes": [n | {"ancestors": spans(n["ancestors"])} for n in self.nodes], "members": self.members}


class Packer:
    """Puts a stream of turns, in the order of the trie, into packs."""

    def __init__(self, tokenizer: tiktoken.Encoding, max_tokens: int) -> None:
        self.tokenizer, self.max_tokens, self.width = tokenizer, max_tokens, max(1, max_tokens // 8)
        self.pack, self.piece, self.size = Pack(), [], 0
        self.chain: str | None = None
        self.member: dict = {}
        self.along = True

    def _segment(self, head: str, body: str, tail: str, learned: bool) -> Segment:
        text, at = head + body + tail, len(self.piece)
        # tokens are at hand as long as the piece follows the open path
        self.along = (self.along or not at) and at < len(self.pack.open) and self.pack.open[at][0].text == text
        if self.along:
            return self.pack.open[at][0]
        tokens = self.tokenizer.encode_ordinary(head)
        start = len(tokens)
        tokens += self.tokenizer.encode_ordinary(body)
        end = len(tokens)
        return Segment(text, tokens + self.tokenizer.encode_ordinary(tail), (start, end) if learned and end > start else None)

    def _flush(self, last: bool) -> Iterator[dict]:
        """The piece goes into the pack, or into the next one if it doesn't fit."""
        if self.piece:
            new = sum(len(s.tokens) for s in self.piece[self.pack.shared(self.piece) :])
            if self.pack.members and (len(self.pack.tokens) + new > self.max_tokens or len(self.pack.members) >= MAX_MEMBERS):
                yield self.pack.row()
                self.pack = Pack()
            whole = last and (self.member["turn"], self.member["slice"]) == (1, 0)
            self.pack.add(self.piece, self.member | {"chain": self.chain, "whole": whole})
            self.piece, self.size = [], 0

    def put(self, chain: str, conv_id: int | None, turn: int, of: int, role: str, text: str) -> Iterator[dict]:
        if chain != self.chain:
            yield from self._flush(False)
            self.chain = chain
        for k, parts in enumerate(segments(role, text, self.width)):
            segment = self._segment(*parts)
            if self.piece and self.size + len(segment.tokens) > self.max_tokens:
                yield from self._flush(False)
                self.along = False
            if not self.piece:
                self.member = {"conv_id": conv_id, "turn": turn, "slice": k}
            self.piece.append(segment)
            self.size += len(segment.tokens)
        if turn == of:
            yield from self._flush(True)

    def rest(self) -> Iterator[dict]:
        yield from self._flush(False)
        if self.pack.members:
            yield self.pack.row()


def _pack_schema() -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    node = pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("ancestors", span)])
    return pa.schema([("tokens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", span), ("nodes", pa.list_(node)), ("members", pa.list_(pa.struct([("chain", pa.string()), ("conv_id", pa.int64()), ("leaf", pa.int32()), ("turn", pa.int64()), ("slice", pa.int32()), ("whole", pa.bool_())])))])


def packs(conversations: DataFrame, vocabulary: str = VOCABULARY, max_tokens: int = MAX_TOKENS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations as packs; vocabulary is a path on the driver, whose bytes are sent to the tasks."""
    spark = conversations.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    # rows without id are told apart by what they say, equal ones by their number
    rows = rows.withColumn("hash", F.xxhash64("role", "text")).withColumn("lone", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "hash")))
    w = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("i", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("path", F.collect_list(F.when(F.col("i") <= PATH, F.col("hash"))).over(every)).withColumn("of", F.count("*").over(every))
    alone = F.col("conv_id").isNull()
    rows = rows.select(
        F.when(alone, F.slice("path", 1, 1)).otherwise(F.col("path")).alias("path"),
        F.when(alone, F.concat_ws(":", F.lit("~"), "lone", "i")).otherwise(F.col("conv_id").cast("string")).alias("chain"),
        F.floor(F.col("i") / TURNS).alias("part"),
        "conv_id",
        *(F.when(alone, F.lit(1)).otherwise(F.col(c)).cast("long").alias(c) for c in ("i", "of")),
        "role",
        "text",
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, schema = Packer(encoding(sent.value), max_tokens), _pack_schema()
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for pack in packer.put(*(v.as_py() for v in row)):
                    yield pa.RecordBatch.from_pylist([pack], schema)
        for pack in packer.rest():
            yield pa.RecordBatch.from_pylist([pack], schema)

    order = ["path", "chain", "part"]
    return rows.repartitionByRange(*order).sortWithinPartitions("path", "chain", "i").select("chain", "conv_id", "i", "of", "role", "text").mapInArrow(build, PACK)


class Digest:
    """Figures of a conversation whose written turns come piece by piece."""

    def __init__(self) -> None:
        self.turns, self.said = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.n_said = self.n_written = 0
        self.rest = ""

    def add(self, written: str, said: str) -> Digest:
        self.n_written += len(written)
        self.n_said += len(said)
        self.said.update(said.encode())
        written, at = self.rest + written, 0
        while m := _TURN.match(written, at):
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.n_turns += 1
            at = m.end()
        self.rest = written[at:]
        return self

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("a turn isn't ended")
        return self.n_turns, self.turns.hexdigest(), self.n_said, self.said.hexdigest(), self.n_written


_FIGURES = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def read_packs(of: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the packs' tokens, nodes and loss masks say of each conversation: digests of its turns, of the text under the mask, and its formatted length."""
    spark = of.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    figures = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = [("chain", pa.string()), ("turn", pa.int64()), ("slice", pa.int32()), ("conv_id", pa.int64()), *_FIGURES, ("written", pa.string()), ("said", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each member: its figures if it is a whole conversation, else what is written and said in it."""
        tokenizer = encoding(sent.value)
        text = lambda ids: tokenizer.decode_bytes(ids).decode()
        for batch in batches:
            for p in (x.as_py() for i in range(batch.num_rows) for x in batch.slice(i, 1).to_struct_array()):
                learned: dict[int, str] = {}
                masks, m = p["loss"], 0
                formatted = []
                for i, node in enumerate(p["nodes"]):
                    formatted.append(text(p["tokens"][node["start"] : node["end"]]))
                    if m < len(masks) and node["start"] <= masks[m]["start"] < node["end"]:
                        learned[i] = unescape(text(p["tokens"][masks[m]["start"] : masks[m]["end"]]))
                        m += 1
                out = []
                for member in p["members"]:
                    path, at = [], member["leaf"]
                    while at >= 0:
                        path.append(at)
                        at = p["nodes"][at]["parent"]
                    path.reverse()
                    whole, said = "".join(formatted[i] for i in path), "".join(learned.get(i, "") for i in path)
                    rest = (*Digest().add(whole, said).row(), None, None) if member["whole"] else (*[None] * len(_FIGURES), whole, said)
                    out.append((*(member[c] for c in ("chain", "turn", "slice", "conv_id")), *rest))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chain, turn and slice: those with figures as they are, pieces put together."""
        names = ["conv_id", *(n for n, _ in _FIGURES)]
        chain, digest, conv_id = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if digest is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv_id, *digest.row()), [pa.int64(), *(k for _, k in _FIGURES)], strict=True)], names)

        for batch in batches:
            pieces = batch.column(len(kinds) - 2).is_valid()
            yield pa.RecordBatch.from_arrays(batch.columns[3 : len(kinds) - 2], names).filter(pc.invert(pieces))
            for row in batch.filter(pieces).to_pylist():
                if row["chain"] != chain:
                    yield from done()
                    chain, digest, conv_id = row["chain"], Digest(), row["conv_id"]
                digest.add(row["written"], row["said"])
        yield from done()

    rows = of.mapInArrow(read, f"chain string, turn long, slice int, conv_id long, {figures}, written string, said string")
    return rows.repartition("chain").sortWithinPartitions("chain", "turn", "slice").mapInArrow(combine, f"conv_id long, {figures}")
