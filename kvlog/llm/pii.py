r"""PII by fixed patterns and a skip-chain conditional random field.

Base spans come from patterns for e-mail addresses, IPv4 addresses, payment cards
(Luhn) and phone numbers; they stay whatever the field says. The field labels the
words that hold a digit, ``@`` or ``+`` (nodes; other words are nothing for
certain) with a kind or none. Nodes that follow each other are linked, and so are
distant nodes that repeat or resemble each other (equal without punctuation and
case, or with the same four digits or more): each with the one before it, so links
grow with the nodes. Words of base spans are fixed to their kind and pass it on
along the links by loopy belief propagation, so "(988) 555-2485" is found where
"+1 (988) 555-2485" stands elsewhere in the document. A word whose belief in a kind
reaches ``SURE`` becomes a span; neighbours of one kind make one span.

The field is trained by pseudo-likelihood on the graphs of whole documents, as it is
applied, with weak labels: words of base spans; words that look like personal data of
a kind without being a base span (ten digits in telephone groups, ``name@host``); words
that a name such as ``token =`` stands before, which make a fifth kind, secrets; and
words that a link joins to one of these. Features of a node are its shape, its digits
and the two words before it. The sample has the graphs of at most ``SAMPLE`` documents,
those with nodes that come first by hash, each of at most ``NODES`` nodes (documents
with more are labelled, but not trained on). Graphs are built where texts are read.

Defined cases: null text has no spans; places are code points, ends exclusive;
repeated rows are judged one by one; an empty table trains nothing and returns
nothing; columns of the caller that have the names of the output give way. Runs of
digits are matched from their first digit only, which finds the same matches and keeps
long runs linear.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm.shared import arrow_schema, hash_bound, without

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: nothing, the kinds of base spans, secrets.
LABELS = ("", *KINDS, "secret")
SAMPLE = 2000
NODES = 1024
SURE = 0.9
FEATURES = 1 << 13
#: Links whose messages are worked out at once.
EDGES = 1 << 16
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@+]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'"
_SECRET = re.compile(r"(?i)(?:token|secret|key|passw(?:or)?d|pwd)[\"']?\s*[=:]\s*[\"']?(?=[^\s\"']*[0-9])[A-Za-z0-9+/_.-]{12,}")
_GROUPED = re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_AT_HOST = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A local part is the run of its characters before an @, from the last match's end on: the leftmost start that can match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def written(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(LABELS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


# -- the field ----------------------------------------------------------------


def _shape(word: str) -> str:
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "9", word))[:16]


class Graph:
    """Nodes of a text, their features, links and fixed labels (0: free, else a kind)."""

    def __init__(self, text: str, base: list[Span]) -> None:
        words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        nodes = [i for i, w in enumerate(words) if _NODE.search(w[2])]
        self.spans = [words[i][:2] for i in nodes]
        self.words = [words[i][2] for i in nodes]
        self.before = [(words[i - 1][2] if i else "", words[i - 2][2] if i > 1 else "") for i in nodes]
        self.labels = np.zeros(len(nodes), np.int64)
        self._starts = np.array([a for a, _ in self.spans], np.int64)
        self._ends = np.array([b for _, b in self.spans], np.int64)
        for kind, a, b in base:
            self.labels[self._inside(a, b)] = LABELS.index(kind)
        self.chain = np.array([(k, k + 1) for k in range(len(nodes) - 1) if nodes[k + 1] == nodes[k] + 1], np.int64).reshape(-1, 2)
        last: dict[str, int] = {}
        skip = set()
        for k, word in enumerate(self.words):
            digits = re.sub("[^0-9]", "", word)
            for key in {"w" + word.strip(_EDGE + "()").lower(), *(["d" + digits] if len(digits) >= 4 else [])}:
                if key in last and last[key] != k:
                    skip.add((last[key], k))
                last[key] = k
        self.skip = np.array(sorted(skip), np.int64).reshape(-1, 2)
        self.features = np.array([[zlib.crc32(f.encode()) % FEATURES for f in self._features(k)] for k in range(len(nodes))], np.int64).reshape(-1, 9)

    def _inside(self, a: int, b: int) -> slice:
        return slice(int(np.searchsorted(self._ends, a, "right")), int(np.searchsorted(self._starts, b)))

    def _features(self, k: int) -> list[str]:
        word = self.words[k].strip(_EDGE)
        shape, digits = _shape(word), sum(c.isdigit() for c in word)
        one, two = (w.strip("(").lower()[-12:] for w in self.before[k])
        return ["1", f"s{shape}", f"n{min(digits, 20)}", f"t{shape[:2]}", f"e{shape[-2:]}", f"c{sum(not c.isalnum() for c in word)}", f"l{min(len(word), 24)}", f"p{one}", f"q{two}"]

    def weak_labels(self, text: str) -> np.ndarray:
        """The fixed labels and, where there is none, those of words that look like personal data or secrets, or are linked to such."""
        out = self.labels.copy()

        def put(label: int, a: int, b: int) -> None:
            own = out[self._inside(a, b)]
            own[own == 0] = label

        for m in _SECRET.finditer(text):
            put(LABELS.index("secret"), m.end() - 1, m.end())
        for m in _GROUPED.finditer(text):
            put(LABELS.index("phone"), m.start(), m.end())
        for k, word in enumerate(self.words):
            if not out[k] and _AT_HOST.fullmatch(word.strip(_EDGE)):
                out[k] = LABELS.index("email")
        for a, b in (*self.skip, *self.skip[::-1, ::-1]):  # what repeats such a word is no example of nothing
            if out[a] > 0 and out[b] == 0:
                out[b] = out[a]
        return out


class Example(NamedTuple):
    """What training takes of a graph."""

    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, text: str) -> Example:
        graph = Graph(text, base_spans(text))
        return cls(graph.features, graph.chain, graph.skip, graph.weak_labels(text))


class Field:
    def __init__(self) -> None:
        n = len(LABELS)
        self.unary = np.zeros((FEATURES, n))
        self.chain = np.zeros((n, n))
        self.skip = 3.0 * np.eye(n)
        self.skip[0, 0] = 0.5

    def train(self, examples: list[Example], rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Pseudo-likelihood: each label given its neighbours' labels."""
        if not sum(len(e.labels) for e in examples):
            return
        n = self.chain.shape[0]
        base = np.cumsum([0, *(len(e.labels) for e in examples)])
        x = np.concatenate([e.features for e in examples])
        y = np.concatenate([e.labels for e in examples])
        chain = np.concatenate([e.chain + b for e, b in zip(examples, base, strict=False)])
        skip = np.concatenate([e.skip + b for e, b in zip(examples, base, strict=False)])
        target = np.eye(n)[y]
        steps = [np.full(w.shape, 1e-3) for w in (self.unary, self.chain, self.skip)]
        prior = self.skip.copy()
        for _ in range(rounds):
            logit = self.unary[x].sum(axis=1)
            np.add.at(logit, chain[:, 0], self.chain[:, y[chain[:, 1]]].T)
            np.add.at(logit, chain[:, 1], self.chain[y[chain[:, 0]]])
            np.add.at(logit, skip[:, 0], self.skip[:, y[skip[:, 1]]].T)
            np.add.at(logit, skip[:, 1], self.skip[y[skip[:, 0]]])
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            error = target - p / p.sum(axis=1, keepdims=True)
            unary = np.stack([np.bincount(x.reshape(-1), weights=np.repeat(error[:, c], x.shape[1]), minlength=FEATURES) for c in range(n)], axis=1)
            links, skips = np.zeros((n, n)), np.zeros((n, n))
            np.add.at(links.T, y[chain[:, 1]], error[chain[:, 0]])
            np.add.at(links, y[chain[:, 0]], error[chain[:, 1]])
            np.add.at(skips.T, y[skip[:, 1]], error[skip[:, 0]])
            np.add.at(skips, y[skip[:, 0]], error[skip[:, 1]])
            skips = (skips + skips.T) / 2
            for w, g, s, p0 in ((self.unary, unary, steps[0], 0), (self.chain, links, steps[1], 0), (self.skip, skips, steps[2], prior)):
                g = g / len(y) - decay * (w - p0)
                s += g * g
                w += rate * g / np.sqrt(s)

    def beliefs(self, graph: Graph, rounds: int = 30, damping: float = 0.2) -> np.ndarray:
        """Marginals of the nodes by loopy sum-product; nodes of base spans are fixed."""
        n = self.chain.shape[0]
        local = self.unary[graph.features].sum(axis=1)
        fixed = graph.labels > 0
        local[fixed] = -50.0
        local[fixed, graph.labels[fixed]] = 0.0
        a = np.concatenate([graph.chain[:, 0], graph.skip[:, 0], graph.chain[:, 1], graph.skip[:, 1]])
        b = np.concatenate([graph.chain[:, 1], graph.skip[:, 1], graph.chain[:, 0], graph.skip[:, 0]])
        half = len(a) // 2
        kind = np.tile(np.concatenate([np.zeros(len(graph.chain), np.int64), np.ones(len(graph.skip), np.int64)]), 2)
        kind[half:] += 2
        pairs = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])  # [kind, from, to]
        message = np.zeros((len(a), n))
        back = np.concatenate([np.arange(half) + half, np.arange(half)])
        total = local
        for _ in range(rounds if len(a) else 0):
            new = np.empty_like(message)
            for i in range(0, len(a), EDGES):
                part = slice(i, i + EDGES)
                send = (total[a[part]] - message[back[part]])[:, :, None] + pairs[kind[part]]
                top = send.max(axis=1)
                new[part] = top + np.log(np.exp(send - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = damping * message + (1 - damping) * new
            total = local + np.stack([np.bincount(b, weights=message[:, c], minlength=len(local)) for c in range(n)], axis=1)
            if change < 1e-4:
                break
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, field: Field, base: list[Span], sure: float = SURE) -> list[Span]:
    """The base spans and those that the field adds beside them."""
    if not _NODE.search(text):
        return base
    graph = Graph(text, base)
    free = graph.labels == 0
    if not free.any():
        return base
    p = field.beliefs(graph)
    kind = p.argmax(axis=1)
    on = free & (kind > 0) & (p[np.arange(len(kind)), kind] >= sure)
    out, run = [], None
    following = {int(i) for i, _ in graph.chain}
    for k in np.flatnonzero(on):
        a, b = graph.spans[k]
        if run and run[0] == kind[k] and run[3] == k - 1 and int(run[3]) in following:
            run = (run[0], run[1], b, k)
        else:
            if run:
                out.append(run)
            run = (kind[k], a, b, k)
    if run:
        out.append(run)
    more = []
    for label, a, b, _ in out:
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        if a < b:  # a run has free nodes only, so no base span is in it
            more.append((LABELS[label], a, b))
    return base + more


def train_field(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, nodes: int = NODES) -> Field:
    """A field trained on the graphs of at most `sample` documents with 1 to `nodes` nodes, those whose key and text hash lowest."""
    own = docs.where(F.col(text).rlike("[0-9@+]")).select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t"))

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                example = Example.of(t.as_py())
                if len(example.labels) <= nodes:
                    rows.append((h, *(x.astype(np.int16).tobytes() for x in example)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if not c else pa.binary()) for c in range(5)], ["h", "features", "chain", "skip", "labels"])

    found = own.where(F.col("h") <= hash_bound(own.count(), sample)).mapInArrow(graphs, "h long, features binary, chain binary, skip binary, labels binary").dropDuplicates(["h"])
    rows = sorted(found.collect(), key=lambda r: r["h"])[:sample]  # somewhat over `sample` rows are below the bound
    read = lambda raw, *shape: np.frombuffer(raw, np.int16).astype(np.int64).reshape(shape)
    field = Field()
    field.train([Example(read(r["features"], -1, 9), read(r["chain"], -1, 2), read(r["skip"], -1, 2), read(r["labels"], -1)) for r in rows])
    return field


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base), base_spans and spans (all, written kind:start:end), secrets (spans of the fifth kind, likewise) and has_pii (whether there is any)."""
    spark = docs.sparkSession
    output = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_spans", T.StringType()), ("spans", T.StringType()), ("secrets", T.StringType()), ("has_pii", T.BooleanType())]
    docs = without(docs, *(c for c, _ in output))
    sent = spark.sparkContext.broadcast(field or train_field(docs, key, text))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in output)])
    arrow = arrow_schema(spark, schema)
    place = docs.columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(place):
                own = t.as_py() or ""
                base = base_spans(own) if _NODE.search(own) else []
                every = all_spans(own, sent.value, base)
                spans, secrets = [s for s in every if s[0] in KINDS], [s for s in every if s[0] not in KINDS]
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), written(base), written(spans), written(secrets), bool(every)))
            new = [pa.array([r[c] for r in rows], arrow.field(name).type) for c, (name, _) in enumerate(output)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return docs.mapInArrow(find, schema)
