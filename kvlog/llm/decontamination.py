"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, white space runs to one space). An
item of m code points may occur with k = m // ``CHARS_PER_EDIT`` edits. It is
split into k + 1 pieces of nearly equal length: k edits can't touch all of them,
so a document that holds the item within k edits holds a piece exactly, at its
place in the item give or take k. One Aho-Corasick pass over the whole text finds
the pieces; overlapping places of an item merge into one window. A window is
verified by Myers' bit-parallel edit distance, after the q-gram lemma has thrown
out windows that can't be within k edits.

Items are sent to the tasks in groups of at most ``GROUP_CHARS`` code points, one
pass over the documents for each group, so what is broadcast has a fixed bound
however long the benchmark is (test sets fit one group).

Items shorter than ``MIN_ITEM`` code points (normalised) have k as well (0 or 1),
but occur at word boundaries only: neither end lies between two letters or digits,
so a short item isn't found inside of longer words.

Defined cases: null or empty texts and items match nothing; items that occur twice under one id count once; a document row is searched
by itself, so repeated rows give repeated matches; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm.shared import arrow_schema

CHARS_PER_EDIT = 12
#: Shorter items have to occur at word boundaries.
MIN_ITEM = 24
GROUP_CHARS = 1 << 22
Q = 4


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the end of the first such substring."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, m, 0
    get = equal.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
    return best, end


def occurrence(item: str, window: str, grams: list[str], k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best occurrence within k edits."""
    at = window.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    there = {window[i : i + Q] for i in range(len(window) - Q + 1)}
    if sum(map(there.__contains__, grams)) < len(item) - Q + 1 - k * Q:
        return None
    distance, end = myers(item, window)
    if distance > k:
        return None
    _, back = myers(item[::-1], window[:end][::-1])
    return distance, end - back, end


def boundary(text: str, at: int) -> bool:
    return not 0 < at < len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


def distance_within(a: str, b: str, k: int) -> int:
    """Edit distance of a and b, or k + 1 if it is larger."""
    lo, x, y = 0, len(a), len(b)
    while lo < min(x, y) and a[lo] == b[lo]:
        lo += 1
    while lo < min(x, y) and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    a, b = a[lo:x], b[lo:y]
    if max(len(a), len(b)) <= 1 or k <= 1:
        return min(max(len(a), len(b)), k + 1)
    row = [*range(len(b) + 1)]
    for i, p in enumerate(a, 1):
        new = [i]
        for j, c in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row[-1], k + 1)


def short_occurrence(item: str, text: str, starts: list[int], k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the first best occurrence at word boundaries, starting within k of the given places."""
    m, best = len(item), None
    for start in sorted({s + d for s in starts for d in range(-k, k + 1)}):
        if not 0 <= start < len(text) or not boundary(text, start):
            continue
        for end in range(max(start + 1, start + m - k), min(len(text), start + m + k) + 1):
            if boundary(text, end):
                distance = distance_within(item, text[start:end], k)
                if distance <= k and (best is None or distance < best[0]):
                    best = distance, start, end
        if best is not None and not best[0]:
            break
    return best


class Matcher:
    def __init__(self, items: Iterable[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT, min_item: int = MIN_ITEM) -> None:
        self.items: list[tuple[int, str, list[str], int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in sorted({(i, normalise(t)) for i, t in items}, key=repr):
            m = len(text)
            if not m:
                continue
            k = m // chars_per_edit
            for p in range(k + 1):
                a, b = p * m // (k + 1), (p + 1) * m // (k + 1)
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((key, text, [text[i : i + Q] for i in range(m - Q + 1)], k))
        self.min_item = min_item
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.some = bool(pieces)

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item, in code points of the normalised text."""
        n = normalise(text)
        if not n or not self.some:
            return []
        spots: dict[int, list[int]] = {}
        for last, (length, places) in self.automaton.iter(n):
            for i, at in places:
                spots.setdefault(i, []).append(last + 1 - length - at)
        found: dict[int, tuple[int, int, int]] = {}
        for i, starts in spots.items():
            key, item, grams, k = self.items[i]
            if len(item) < self.min_item:
                if (hit := short_occurrence(item, n, starts, k)) is not None:
                    found[key] = min(found.get(key, hit), hit)
                continue
            starts.sort()
            lo = hi = None
            for start in [*starts, None]:
                if lo is not None and (start is None or start - k > hi):
                    a = max(0, lo)
                    if (hit := occurrence(item, n[a:hi], grams, k)) is not None:
                        hit = hit[0], hit[1] + a, hit[2] + a
                        found[key] = min(found.get(key, hit), hit)
                    lo = None
                if start is not None:
                    lo = start - k if lo is None else lo
                    hi = start + len(item) + k
        return [(key, *hit) for key, hit in sorted(found.items())]


def _groups(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, in groups of a bounded size."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-2 * chars // GROUP_CHARS) if chars > GROUP_CHARS else 1
    for g in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == g)
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, min_item: int = MIN_ITEM) -> DataFrame:
    """One row for each document and item that occurs in it: key, item, distance, start, end."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType), *(T.StructField(n, T.IntegerType()) for n in ("distance", "start", "end"))])
    arrow = arrow_schema(spark, schema)
    out = None
    for items in _groups(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, chars_per_edit, min_item)
            for batch in batches:
                rows, hits = [], []
                for i, t in enumerate(batch.column(1)):
                    for hit in matcher.matches(t.as_py()):
                        rows.append(i)
                        hits.append(hit)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([h[c] for h in hits], type=arrow.field(c + 1).type) for c in range(4))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        part = docs.select(key, text).mapInArrow(find, schema)
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT, min_item: int = MIN_ITEM) -> DataFrame:
    """docs without the documents that hold a benchmark item; filtered where they are read, nothing is shuffled."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    schema, arrow = docs.schema, arrow_schema(spark, docs.schema)
    for items in _groups(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, chars_per_edit, min_item)
            for batch in batches:
                keep = pa.array([not matcher.matches(t.as_py()) for t in batch.column(at)], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.columns, schema=arrow).filter(keep)

        docs = docs.mapInArrow(clean, schema)
    return docs
