"""SentencePiece encoding and decoding: n-best segmentation over the piece lattice.

The model's pieces and scores are taken as they are. A text, with spaces as U+2581
and one more before it, is a lattice: an edge for each piece, and byte pieces
behind the unknown score (the smallest piece score less 10) where a character has
no piece. The best segmentations are those with the greatest sums of scores.

Forward Viterbi gives every node its exact best score from the start. Backward
A-star from the end takes these as heuristics, so each hypothesis it pops has the
greatest total of all that are left, and the first n that reach the start are the
n best. No piece has U+2581 behind another character, so no edge crosses into a
run of spaces: a lattice falls into chunks (spaces and the word behind them).
A chunk's lattice is searched once and cached; what the forward and backward
scores say of its second best is its gap. Of a document's n best only the n - 1
chunks with the smallest gaps can differ from the best, and the same A-star runs
over the chain of these chunks' own n best. Scores are whole numbers, so sums and
comparisons are exact.

Defined cases: null or empty text has no pieces, score 0 and decodes to empty;
literal U+2581 is encoded by bytes, so decoding gives the text back, always;
equal scores come in a fixed order; fewer than n segmentations give fewer scores;
repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kvlog.llm.shared import arrow_schema, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
UNKNOWN_PENALTY = 10
#: Chunks kept by a task before it starts anew.
CACHE = 500_000
#: Lattices are made alike by filling them up to a multiple of this.
PAD = 4
NBEST_CACHE = 20_000
#: Edges of alike lattices that are searched together.
AT_ONCE = 1 << 18
NEVER = -(1 << 60)
DONE = -(1 << 31)
#: Stands for a literal U+2581 in a lattice; only its place counts.
_LITERAL = "\ufdd0"
_OUTPUT = (
    ("ids", T.ArrayType(T.IntegerType(), False)),
    ("n_pieces", T.LongType()),
    ("scores", T.ArrayType(T.LongType(), False)),
    ("alternatives", T.ArrayType(T.ArrayType(T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]), False), False)),
)

Edges = list[list[tuple[int, int, object]]]


def forward(into: Edges) -> list[int]:
    """Best score from node 0 to each node; into[v] has (u, score, label)."""
    best = [0] * len(into)
    for v in range(1, len(into)):
        best[v] = max(best[u] + s for u, s, _ in into[v])
    return best


def a_star(into: Edges, ahead: list[int], n: int) -> list[tuple[int, list]]:
    """The n best paths, best first, as (score, labels); ahead has each node's exact best score from node 0."""
    last = len(into) - 1
    agenda: list[tuple] = [(-ahead[last], 0, last, 0, None)]
    pushed, popped, out = 0, [0] * len(into), []
    while agenda and len(out) < n:
        total, _, v, behind, path = heapq.heappop(agenda)
        popped[v] += 1
        if popped[v] > n:
            continue
        if v == 0:
            labels = []
            while path:
                label, path = path
                labels.append(label)
            out.append((-total, labels))
            continue
        for u, s, label in into[v]:
            pushed += 1
            heapq.heappush(agenda, (-(ahead[u] + s + behind), pushed, u, behind + s, (label, path)))
    return out


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ (c + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hash(s: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in s:
        h = _extend(h, np.array([ord(c)], np.uint64))
    return int(h[0])


class _Table:
    """Places of 64-bit keys, looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray) -> None:
        if len(np.unique(keys)) < len(keys) or not keys.all():
            raise ValueError("prefixes of pieces share a hash")
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for i, key in enumerate(keys):
            at = int(key) >> (64 - self.bits)
            while self.places[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.places[at] = key, i

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.places[at], -1)
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.keys)
            there = self.keys[at[rest]]
            out[rest] = np.where(there == keys[rest], self.places[at[rest]], -1)
            rest = rest[(there != keys[rest]) & (there != 0)]
        return out


class Segmenter:
    def __init__(self, proto: bytes, n: int = 4) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.vocabulary = {sp.id_to_piece(i): (int(sp.get_score(i)), i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.vocabulary):
            raise ValueError("a piece with a space behind another character: lattices don't fall into chunks")
        self.longest = max(map(len, self.vocabulary))
        starts = sorted({p[:i] for p in self.vocabulary for i in range(1, len(p) + 1)})
        self.prefixes = _Table(np.array([_hash(p) for p in starts], np.uint64))
        self.prefix_score = np.array([self.vocabulary.get(p, (NEVER, 0))[0] for p in starts])
        self.prefix_id = np.array([self.vocabulary.get(p, (NEVER, 0))[1] for p in starts], np.int32)
        self.unknown = min(s for s, _ in self.vocabulary.values()) - UNKNOWN_PENALTY
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decoded: list[bytes] = [b""] * len(ids)
        for piece, (_, i) in self.vocabulary.items():
            self.decoded[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.decoded[i] = bytes([b])
        self.n = n
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)  # ids of the chunks' best segmentations, one behind another
        self.ends = np.zeros(1, np.int64)
        self.score = np.zeros(0, np.int64)
        self.gap = np.zeros(0)
        self.nbest: dict[str, list[tuple[int, list[int]]]] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Each chunk as its word behind one space less than it has."""
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for part in parts:
            if part:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            out.append(" " * (spaces - 1))
        return out

    def lattice(self, chunk: str) -> Edges:
        s = SPACE + chunk.replace(SPACE, _LITERAL).replace(" ", SPACE)
        n, get, longest = len(s), self.vocabulary.get, self.longest
        into: Edges = [[] for _ in range(n + 1)]
        for u in range(n):
            if (one := get(s[u : u + 1])) is None:
                into[u + 1].append((u, self.unknown, ~u))
            else:
                into[u + 1].append((u, *one))
            for v in range(u + 2, min(n, u + longest) + 1):
                if (piece := get(s[u:v])) is not None:
                    into[v].append((u, *piece))
        return into

    def _ids(self, chunk: str, labels: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        for label in labels:
            if label >= 0:
                out.append(label)
            else:
                out.extend(self.bytes[b] for b in (" " + chunk)[~label].encode())
        return tuple(out)

    def add(self, chunks: list[str]) -> None:
        """Search the lattices of new chunks: best segmentation, its score and the gap to the second best."""
        alike: dict[int, list[str]] = {}
        for chunk in chunks:
            alike.setdefault((len(chunk) + PAD) // PAD * PAD, []).append(chunk)
        found = []
        for n, group in alike.items():
            step = max(1, AT_ONCE // (n * min(n, self.longest)))
            for i in range(0, len(group), step):
                found.append(self._add_alike(group[i : i + step], n))
        if found:
            flat, sizes, score, gap = (np.concatenate(x) for x in zip(*found, strict=True))
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks by their places, one behind another, and how many each has."""
        starts = self.ends[at]
        sizes = self.ends[at + 1] - starts
        upto = np.cumsum(sizes)
        where = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + sizes, sizes)
        return self.flat[where], sizes

    def _add_alike(self, chunks: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi forward and backward over lattices filled up to n characters, node by node for all chunks together."""
        k = len(chunks)
        text = "".join((SPACE + c.replace(SPACE, _LITERAL).replace(" ", SPACE)).ljust(n, _LITERAL) for c in chunks)
        last = np.fromiter(map(len, chunks), np.int64, k) + 1  # the node where a chunk ends
        chars = np.ascontiguousarray(np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(k, n).T).astype(np.uint64)
        best = np.full((n + 1, k), NEVER)
        best[0] = 0
        came, label = np.zeros((n + 1, k), np.int32), np.zeros((n + 1, k), np.int32)
        edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # from, to, chunks that have the edge, scores

        def relax(u: int, v: int, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
            total = best[u][rows] + score
            better = total > best[v][rows]
            won = rows[better]
            best[v][won], came[v][won], label[v][won] = total[better], u, ids[better]
            edges.append((u, v, rows, score))

        for u in range(n):
            rows, h = np.arange(k), np.zeros(k, np.uint64)
            for v in range(u + 1, min(n, u + self.longest) + 1):  # rows: the chunks where s[u:v] begins a piece
                h = _extend(h, chars[v - 1][rows])
                at = self.prefixes.find(h)
                on = at >= 0
                if v == u + 1:
                    bare = np.flatnonzero(~on | (self.prefix_score[at] == NEVER))
                    if len(bare):
                        relax(u, v, bare, np.full(len(bare), self.unknown), np.full(len(bare), ~u))
                rows, h, at = rows[on], h[on], at[on]
                if not len(rows):
                    break
                score = self.prefix_score[at]
                whole = score != NEVER
                relax(u, v, rows[whole], score[whole], self.prefix_id[at[whole]])
        taken = np.full((n + 1, k), -1, np.int32)  # where the best path comes from, at its own nodes
        column, node = np.arange(k), last.copy()
        labels = []
        while node.any():
            labels.append(np.where(node > 0, label[node, column], DONE))
            taken[node, column] = np.where(node > 0, came[node, column], -1)
            node = np.where(node > 0, came[node, column], 0)
        back = np.full((n + 1, k), NEVER)
        back[last, column] = 0
        second = np.full(k, NEVER)
        for u, v, rows, score in reversed(edges):
            rest = score + back[v][rows]
            back[u][rows] = np.maximum(back[u][rows], rest)
            other = taken[v][rows] != u
            second[rows[other]] = np.maximum(second[rows[other]], (best[u][rows] + rest)[other])
        own = np.array(labels[::-1]).T
        there = own != DONE
        bare = (there & (own < 0)).any(axis=1)  # chunks with characters that have no piece
        lists = [self._ids(chunks[i], own[i][there[i]].tolist()) for i in np.flatnonzero(bare)]
        order = np.concatenate([np.flatnonzero(~bare), np.flatnonzero(bare)])
        sizes = np.concatenate([there[~bare].sum(axis=1), np.array([len(x) for x in lists], np.int64)])
        flat = np.concatenate([own[~bare][there[~bare]], np.array([i for x in lists for i in x], np.int64)])
        self.index.update(zip(map(chunks.__getitem__, order.tolist()), range(len(self.index), len(self.index) + k), strict=True))
        total = best[last, column]
        return flat, sizes, total[order], np.where(second < NEVER // 2, np.inf, (total - second).astype(float))[order]

    def best_of(self, chunk: str) -> list[tuple[int, list[int]]]:
        """The chunk's own n best, the cached best one first."""
        if (out := self.nbest.get(chunk)) is None:
            if len(self.nbest) > NBEST_CACHE:
                self.nbest = {}
            into = self.lattice(chunk)
            found = [(s, self._ids(chunk, labels)) for s, labels in a_star(into, forward(into), self.n + 1)]
            at = self.index[chunk]
            first = tuple(self.flat[self.ends[at] : self.ends[at + 1]].tolist())
            rest = [x for x in found if x[1] != first][: self.n - 1]
            self.nbest[chunk] = out = [(int(self.score[at]), first), *rest]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list]]:
        """Of each text: the ids of its best segmentation (one text behind another) and how many, the scores of the n best, what each but the best has in other chunks."""
        if len(self.index) > CACHE:
            self._reset()
        split = [self.chunks(text or "") for text in texts]
        self.add(list({c for chunks in split for c in chunks if c not in self.index}))
        every = np.fromiter((i for chunks in split for i in map(self.index.__getitem__, chunks)), np.int64)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in split], dtype=np.int64)])
        all_gaps, all_scores = self.gap[every], np.concatenate([[0], np.cumsum(self.score[every])])
        scores, others = [], []
        for k, chunks in enumerate(split):
            total = int(all_scores[ends[k + 1]] - all_scores[ends[k]])
            gaps = all_gaps[ends[k] : ends[k + 1]]
            most = min(self.n - 1, len(chunks))
            near = np.argpartition(gaps, most - 1)[:most] if most else []
            near = sorted(int(i) for i in near if gaps[i] < np.inf)
            into: Edges = [[]]
            for place, i in enumerate(near):
                own = self.best_of(chunks[i])
                into.append([(place, s - own[0][0], (i, k)) for k, (s, _) in enumerate(own)])
            paths = a_star(into, forward(into), self.n)
            scores.append([total + s for s, _ in paths])
            others.append([[{"chunk": i, "ids": list(self.best_of(chunks[i])[k][1])} for i, k in labels if k] for _, labels in paths[1:]])
        ids, sizes = self.ids_of(every)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[ends[1:]] - upto[ends[:-1]], scores, others

    def decode(self, ids: np.ndarray) -> str:
        """The text behind piece ids (its first character is the space put before it)."""
        return b"".join(map(self.decoded.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


_SEGMENTERS: dict[tuple[int, int], Segmenter] = {}


def _segmenter(proto: bytes, n: int) -> Segmenter:
    key = (hash(proto), n)
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(proto, n)
    return _SEGMENTERS[key]


def _list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def encode_nbest(docs: DataFrame, model: str = MODEL, n: int = 4, text: str = "text", decoded: str | None = None, rows_at_once: int = 512) -> DataFrame:
    """docs plus ids (the best segmentation), n_pieces, scores (of the n best) and alternatives (each next best, as the chunks in which it differs).

    With `decoded`, one more column of that name has the text that decoding ids
    gives, made in the same pass. model is a path on the driver; its bytes are
    sent to the tasks.
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    output = [*_OUTPUT, *([(decoded, T.StringType())] if decoded else [])]
    docs = without(docs, *(c for c, _ in output))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in output)])
    arrow = arrow_schema(spark, schema)
    place = docs.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(sent.value, n)
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                ids, lengths, scores, others = seg.encode(batch.column(place).to_pylist())
                new = [_list_array(ids, lengths), pa.array(lengths), pa.array(scores, arrow.field("scores").type), pa.array(others, arrow.field("alternatives").type)]
                if decoded:
                    ends = np.concatenate([[0], np.cumsum(lengths)])
                    new.append(pa.array([seg.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                new = [x.cast(arrow.field(c).type) for x, (c, _) in zip(new, output, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return docs.mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded plus the text behind its piece ids; null ids give null."""
    spark = encoded.sparkSession
    with open(model, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    encoded = without(encoded, to)
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])
    arrow = arrow_schema(spark, schema)
    place = encoded.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(sent.value, 1)
        for batch in batches:
            column = batch.column(place)
            texts = [None if not x.is_valid else seg.decode(x.values.to_numpy(zero_copy_only=False)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=arrow)

    return encoded.mapInArrow(decode, schema)
