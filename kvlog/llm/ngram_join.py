"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles (64-bit hashes). Documents
with one and the same set (named by 64 bits that are held against 64 more) are one node; nodes whose sets reach the Jaccard
threshold are linked, and what comes back is each document's component.

Tokens are ordered rare to frequent. In a set of s tokens that shares enough with
another, at most tau tokens are missing there, so its first tau + 1 tokens hold a
shared one: the prefix that is indexed. Tokens fall into classes by frequency.
Rare ones are indexed singly. Frequent ones (passages that many documents share)
would make long lists; they are dealt by hash into small groups and indexed as
pairs within a group, and the prefix is extended by one token for each group it
touches, since a group of n tokens loses its last common pair only after n - 1
misses. Two sets that reach the threshold thus share a signature, always.
Sets so small that no other set can reach the threshold with them aren't indexed.
Signatures carry the size level (powers of two) of the larger set; a set near a
level's end is indexed under both, so tau and the groups agree on both sides.

The frequency of a token is an estimate from a sketch of fixed size over all
texts. It steers which signatures there are, never what is linked.

Lists of a signature are compared by parity bitmaps: the bits in which two bitmaps
differ are at most the tokens in which the sets differ, so a pair whose bitmaps
differ by more than the threshold allows is out for certain. Within a list only a
minimum spanning forest of the other pairs is passed on, so a list of n near
copies makes at most n - 1 pairs. These are verified on the sets themselves. Then
lists that still hold several components pass on every pair that spans two and is
not ruled out, by bitmaps of four times the width, so that pairs just below the
threshold mostly stay behind; they leave in batches of ``PAIRS``. After their verification no link between components is left. Lists
beyond ``LIST`` sets are compared block by block, which bounds a task's memory.

Defined cases: null, empty or blank texts have empty sets and link with nothing;
texts with fewer words than a shingle are one shingle of all their words; repeated
rows are documents of their own with one id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm import kernels
from kvlog.llm.components import components
from kvlog.llm.shared import bitmap, in_bitmap, left_out, staged

U64 = np.uint64
SLOT_BITS = 20
BLOCK_BITS = 16
#: Merges of partial sketches before the last.
SKETCH_SALTS = 256
#: Sets of a list that are compared in one go.
LIST = 4096
#: Pairs of a list that leave in one batch.
PAIRS = 1 << 16
#: How much wider the bitmaps of the second pass are (up to 65,536 bits).
WIDER = 4
#: Levels (bit lengths of the size) from which frequent tokens are paired: a prefix of three tokens or fewer can't always be extended.
PAIRED_FROM = 3


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    starts, ends, first = kernels.words(data, offs)
    hashes = kernels.span_hashes(data, starts, ends, fold=True)
    grams, at = kernels.windows(hashes, first, n)
    for i in range(len(offs) - 1):
        size = first[i + 1] - first[i]
        if size >= n:
            yield np.unique(grams[at[i] : at[i + 1]])
        elif size:
            h = np.array([size], U64)
            for w in hashes[first[i] : first[i + 1]]:
                h = kernels.mix(h * U64(31) + w)
            yield h
        else:
            yield np.zeros(0, U64)


def _sum_hash(tokens: np.ndarray, salt: int) -> np.ndarray:
    h = np.array([len(tokens)], U64) * U64(0x9E3779B97F4A7C15) + kernels.mix(tokens ^ U64(salt)).sum(dtype=U64)
    return kernels.mix(h)


def set_hash(tokens: np.ndarray, met: frozenset[int] = frozenset()) -> int:
    """64 bits that stand for a set; for those in which different sets have met, others that take in the second half as well."""
    h = _sum_hash(tokens, 0x5851F42D4C957F2D)
    if met and int(h.view(np.int64)[0]) in met:
        h = kernels.mix(h * U64(3) + _sum_hash(tokens, 0x2545F4914F6CDD1D))
    return int(h.view(np.int64)[0])


def second_half(tokens: np.ndarray) -> int:
    """64 more bits, by which sets that meet in the first are told apart."""
    return int(_sum_hash(tokens, 0x2545F4914F6CDD1D).view(np.int64)[0])


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - SLOT_BITS)).astype(np.int64)


# -- frequency sketch ---------------------------------------------------------


def frequency_sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Occurrences of shingles by slot of their hash, over all texts; 2**SLOT_BITS counters at any size of the corpus."""
    width, block = 1 << SLOT_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for _, data, offs in kernels.blocks(batch, text):
                starts, ends, first = kernels.words(data, offs)
                grams, _ = kernels.windows(kernels.span_hashes(data, starts, ends, fold=True), first, n)
                total += np.bincount(_slot(grams), minlength=width)
        if total.any():
            salt = TaskContext.get().partitionId() % SKETCH_SALTS  # the same when a task is run again
            parts = total.reshape(-1, block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([salt] * len(parts), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "salt", "counts"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in parts:
            key = batch.column(0)[0].as_py()
            for raw in batch.column(2):
                x = np.frombuffer(raw.as_py(), np.int64)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "salt", "counts"])

    schema = "block int, salt int, counts binary"
    parts = docs.select(text).mapInArrow(count, schema)
    parts = parts.groupBy("block", "salt").applyInArrow(lambda t: pa.Table.from_batches(merge(iter(t.to_batches()))), schema)
    parts = parts.groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(merge(iter(t.to_batches()))), schema)
    out = np.zeros((width // block, block), np.int64)
    for row in parts.collect():  # width // block rows
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def _threshold(sketch: np.ndarray) -> float:
    """What a slot holds by chance of rare tokens, and some more; beyond that its tokens count as frequent."""
    mean = float(np.median(sketch))
    return mean + 6 * mean**0.5 + 64


# -- signatures ---------------------------------------------------------------


def need(total: int, percent: int) -> int:
    """The least intersection of two sets with so many tokens together that reaches the threshold."""
    return -(-percent * total // (100 + percent))


def levels(size: int, percent: int) -> list[tuple[int, int]]:
    """(level, tau) under which a set is indexed: for partners up to its own level's size and beyond."""
    own = size.bit_length()
    smallest = -(-percent * size // 100)
    out = [(own, size - need(size + smallest, percent))]
    most = 100 * size // percent
    for level in range(own + 1, most.bit_length() + 1):
        out.append((level, size - need(size + (1 << (level - 1)), percent)))
    return out


def signatures(tokens: np.ndarray, counts: np.ndarray, frequent_from: float, level: int, tau: int) -> np.ndarray:
    """Signatures of a set under a level; tokens and the estimates of their frequency in the global order."""
    salt = U64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    if level < PAIRED_FROM:
        return kernels.mix(tokens[: tau + 1] + salt)
    groups = U64(max(1, (1 << level) // 16))
    frequent = counts > frequent_from
    weight = np.ones(len(tokens), np.int64)
    where = np.flatnonzero(frequent)
    if len(where):
        _, first = np.unique(tokens[where] % groups, return_index=True)
        weight[where[first]] = 0
    size = int(np.searchsorted(np.cumsum(weight), tau + 1)) + 1
    if size > len(tokens):
        raise ValueError("a prefix can't cover the threshold")
    prefix, frequent = tokens[:size], frequent[:size]
    out = [kernels.mix(prefix[~frequent] + salt)]
    pairs = np.sort(prefix[frequent])
    pairs = pairs[np.argsort(pairs % groups, kind="stable")]
    group = pairs % groups
    for step in range(1, len(pairs)):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        out.append(kernels.mix(kernels.mix(pairs[:-step][same] + salt) * U64(3) + pairs[step:][same]))
    return np.concatenate(out)


def parity(tokens: np.ndarray, level: int) -> bytes:
    """Parity of the tokens in each of one or two bits a token, 256 at least."""
    return _parity(tokens, 1 << min(16, max(8, level)))


def wide_parity(tokens: np.ndarray, level: int) -> tuple[int, bytes]:
    """Bytes of the bitmap that parity gives, and a wider one; empty where that has the greatest width already."""
    bits = 1 << min(16, max(8, level))
    wide = min(1 << 16, WIDER * bits)
    return bits // 8, _parity(tokens, wide) if wide > bits else b""


def _parity(tokens: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((kernels.mix(tokens ^ U64(0xA0761D6478BD642F)) >> U64(48)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


_ENTRY = pa.struct([("level", pa.int8()), ("bits", pa.binary()), ("signatures", pa.list_(pa.int64()))])
_CARD = pa.schema([("row_id", pa.int64()), ("set", pa.int64()), ("more", pa.int64()), ("n_shingles", pa.int64()), ("entries", pa.list_(_ENTRY))])


def _cards(batches: Iterator[pa.RecordBatch], text: str, n: int, percent: int, sketch: np.ndarray, met: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """One row a document; the entries of a set are left out where this task has just given them for an equal set."""
    frequent_from = _threshold(sketch)
    given: set[int] = set()
    for batch in batches:
        for rows, data, offs in kernels.blocks(batch, text):
            if len(given) > 1 << 20:
                given = set()
            out = []
            for tokens in shingle_sets(data, offs, n):
                size, key = len(tokens), set_hash(tokens, met)
                more = second_half(tokens) if size else 0
                entries = []
                if key not in given and 100 * size >= percent * (size + 1):
                    given.add(key)
                    counts = sketch[_slot(tokens)]
                    order = np.lexsort((tokens, counts))
                    tokens, counts = tokens[order], counts[order]
                    for level, tau in levels(size, percent):
                        entries.append({"level": level, "bits": parity(tokens, level), "signatures": signatures(tokens, counts, frequent_from, level, tau).view(np.int64)})
                out.append((key, more, size, entries))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([o[c] for o in out], pa.int64()) for c in range(3)), pa.array([o[3] for o in out], _CARD.field("entries").type)], schema=pa.schema([rows.schema.field(0), *list(_CARD)[1:]]))


# -- lists --------------------------------------------------------------------


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (signature, set, level), sorted: those of signatures with two sets or more, each set once."""
    last, waiting, shown = None, None, None  # the last (signature, set); a signature's first row until a second comes; the last signature that was passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, own, level = (batch.column(c).to_numpy() for c in range(3))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        if last is not None and (sig[0], own[0]) == last:
            new[0] = False
        last = (sig[-1], own[-1])
        sig, own, level = sig[new], own[new], level[new]
        if not len(sig):
            continue
        follows = np.zeros(len(sig) + (waiting is not None), bool)
        if waiting is not None:
            sig, own, level = (np.concatenate([[w], x]) for w, x in zip(waiting, (sig, own, level), strict=True))
        elif shown is not None:
            follows[0] = sig[0] == shown
        follows[1:] = sig[1:] == sig[:-1]
        keep = follows.copy()
        keep[:-1] |= follows[1:]
        waiting = None if keep[-1] else (sig[-1], own[-1], level[-1])
        shown = sig[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(own[keep]), pa.array(level[keep].astype(np.int8))], ["signature", "set", "level"])


class _List:
    """The sets of one list: keys, sizes, bitmaps, and the components they are known to be in."""

    def __init__(self, rows: list[tuple], percent: int) -> None:
        rows.sort()
        self.percent = percent
        self.keys = [r[0] for r in rows]
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.bits = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), -1)
        self.roots = np.array([r[3] for r in rows], np.int64)
        wide = b"".join(r[4] for r in rows if len(r) > 4)
        self.bitmaps = [self.bits, np.frombuffer(wide, np.uint64).reshape(len(rows), -1)] if wide else [self.bits]

    def away(self, i: int, others: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Bits in which i differs from the others, or a large number where the pair is ruled out."""
        differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        total = self.sizes[others] + self.sizes[i]
        allowed = total - 2 * -(-self.percent * total // (100 + self.percent))
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        return np.where((differ <= allowed) & (100 * small >= self.percent * large), differ, 1 << 30)

    def forest(self) -> Iterator[tuple[int, int]]:
        """A minimum spanning forest of the pairs that aren't ruled out (Prim's algorithm)."""
        left = np.arange(1, len(self.keys))
        best, at, i = np.full(len(left), 1 << 30), np.zeros(len(left), np.int64), 0
        while len(left):
            away = self.away(i, left, self.bits)
            nearer = away < best
            best, at = np.where(nearer, away, best), np.where(nearer, i, at)
            k = int(best.argmin())
            i = int(left[k])
            if best[k] < 1 << 30:
                yield self.keys[at[k]], self.keys[i]
            keep = np.arange(len(left)) != k
            left, best, at = left[keep], best[keep], at[keep]

    def spanning(self) -> Iterator[tuple[int, int]]:
        """All pairs of two components that aren't ruled out."""
        for i in range(len(self.keys) - 1):
            others = np.flatnonzero(self.roots[i + 1 :] != self.roots[i]) + i + 1
            for bits in self.bitmaps:
                if len(others):
                    others = others[self.away(i, others, bits) < 1 << 30]
            for j in others:
                yield self.keys[i], self.keys[j]


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, spanning: bool) -> Iterator[pa.RecordBatch]:
    """Rows (list, part, set, size, bits, root), sorted by list and part; with wider bitmaps behind them if spanning."""
    key, held = None, []

    def pairs() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        of = _List(held, percent)
        if spanning and len(np.unique(of.roots)) < 2:
            return
        for found in itertools.batched(of.spanning() if spanning else of.forest(), PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                yield from pairs()
                key, held = row[:2], []
            held.append(row[2:])
    yield from pairs()


def _lists(cards: DataFrame) -> DataFrame:
    """(list, part, set, size, bits): the sets of each list that isn't another's double, long lists in pairs of blocks."""
    entries = cards.select("set", "n_shingles", F.explode("entries").alias("e"))
    rows = entries.select(F.explode("e.signatures").alias("signature"), "set", F.col("e.level").alias("level"))
    shared = rows.repartition("signature").sortWithinPartitions("signature", "set").mapInArrow(_shared, "signature long, set long, level byte")
    shared = staged(shared, "ngram-shared")
    # lists with the same sets: one is enough
    alike = shared.groupBy("signature").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set", F.lit(1)).cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(2))).alias("y"), F.first("level").alias("level"))
    chosen = alike.groupBy("n", "x", "y", "level").agg(F.min("signature").alias("signature")).select("signature", "n")
    members = shared.join(chosen.hint("merge"), "signature")
    blocks = F.ceil(F.col("n") / LIST).cast("int")
    own = F.pmod(F.xxhash64("set"), blocks).cast("int")
    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    members = members.select("signature", F.explode(parts).alias("part"), "set", "level")
    bits = entries.select("set", "n_shingles", F.col("e.level").alias("level"), F.col("e.bits").alias("bits")).groupBy("set", "level").agg(F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
    return members.join(bits.hint("merge"), ["set", "level"]).select(F.col("signature").alias("list"), "part", "set", "size", "bits")


def _pairs(lists: DataFrame, percent: int, spanning: bool) -> DataFrame:
    rows = lists.repartition("list", "part").sortWithinPartitions("list", "part").select("list", "part", "set", "size", "bits", "root", *(["wide"] if spanning else []))
    return rows.mapInArrow(lambda it: _candidates(it, percent, spanning), "a long, b long").distinct()


def _wide(batches: Iterator[pa.RecordBatch], text: str, n: int, percent: int, wanted: Broadcast, met: frozenset[int]) -> Iterator[pa.RecordBatch]:
    given: set[int] = set()
    for batch in batches:
        for _, data, offs in kernels.blocks(batch, text):
            rows = {}
            for tokens in shingle_sets(data, offs, n):
                key = set_hash(tokens, met)
                if len(tokens) and key not in given and in_bitmap(wanted.value, np.array([key]))[0]:
                    if len(given) > 1 << 20:
                        given = set()
                    given.add(key)
                    for level, _ in levels(len(tokens), percent):
                        width, wide = wide_parity(tokens, level)
                        rows[key, width] = wide
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.int32()), pa.array([*rows.values()], pa.binary())], ["set", "width", "wide"])


def _widened(docs: DataFrame, text: str, n: int, percent: int, lists: DataFrame, met: frozenset[int]) -> DataFrame:
    """lists with wide, a wider bitmap of each set."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(lists, "set"))
    wide = docs.select(text).mapInArrow(lambda it: _wide(it, text, n, percent, wanted, met), "set long, width int, wide binary").dropDuplicates(["set", "width"])
    return lists.withColumn("width", F.octet_length("bits")).join(wide.hint("merge"), ["set", "width"])


# -- verification -------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch], text: str, n: int, wanted: Broadcast, met: frozenset[int]) -> Iterator[pa.RecordBatch]:
    given: set[int] = set()
    for batch in batches:
        for _, data, offs in kernels.blocks(batch, text):
            keys, sets = [], []
            for tokens in shingle_sets(data, offs, n):
                if not len(tokens):
                    continue
                key = set_hash(tokens, met)
                if key not in given and in_bitmap(wanted.value, np.array([key]))[0]:
                    if len(given) > 1 << 20:
                        given = set()
                    given.add(key)
                    keys.append(key)
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])


def _verified(docs: DataFrame, text: str, n: int, percent: int, pairs: DataFrame, met: frozenset[int]) -> DataFrame:
    """pairs with linked: whether the sets reach the threshold."""
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    wanted = spark.sparkContext.broadcast(bitmap(nodes, "node"))
    sets = docs.select(text).mapInArrow(lambda it: _sets(it, text, n, wanted, met), "node long, tokens binary").join(nodes.distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    sets = staged(sets, "ngram-sets")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean")


#: Sets that may share their 64 bits with another; beyond it something is wrong, since n sets have n * n / 2**65 by chance.
MOST_MET = 1 << 16


def _card_table(docs: DataFrame, words: int, percent: int, sketch: Broadcast) -> tuple[DataFrame, frozenset[int]]:
    """The cards of all documents, and the 64-bit names in which different sets met. Names are held against 64 more bits, and given anew where that was so."""
    spark = docs.sparkSession
    entry = "array<struct<level:tinyint,bits:binary,signatures:array<bigint>>>"
    schema = T.StructType([T.StructField("row_id", docs.schema["row_id"].dataType), *T._parse_datatype_string(f"set long, more long, n_shingles long, entries {entry}").fields])
    met: frozenset[int] = frozenset()
    while True:
        cards = staged(docs.mapInArrow(lambda it, met=met: _cards(it, "text", words, percent, sketch.value, met), schema), "ngram-cards")
        shared = cards.where("n_shingles > 0").groupBy("set").agg(F.min("more").alias("a"), F.max("more").alias("b")).where("a <> b").select("set").limit(MOST_MET).collect()
        if not shared:
            return cards, met
        if len(shared) == MOST_MET:
            raise RuntimeError("too many sets share a name")
        met |= {r["set"] for r in shared}


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key of a document's component) for each row of docs."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("row_id"), F.col(text).alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, "text", words))
    cards, met = _card_table(docs, words, percent, sketch)
    lists = staged(_lists(cards), "ngram-lists")
    first = staged(_verified(docs, "text", words, percent, staged(_pairs(lists.withColumn("root", F.lit(0).cast("long")), percent, False), "ngram-pairs"), met), "ngram-verified")
    linked = first.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(linked, "ngram-components")
    # the only pair of a list of two has been looked at; of the others, those that hold several components count
    longer = lists.join(lists.groupBy("list", "part").agg(F.count("*").alias("n")).where("n > 2").drop("n").hint("merge"), ["list", "part"])
    known = longer.join(roots.select(F.col("node").alias("set"), "root").hint("merge"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = known.groupBy("list", "part").agg(F.min("root").alias("r"), F.max("root").alias("q")).where("r <> q").select("list", "part")
    known = staged(known.join(mixed.hint("merge"), ["list", "part"]), "ngram-mixed")
    known = _widened(docs, "text", words, percent, known, met)
    rest = staged(_pairs(known, percent, True).join(first.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "ngram-pairs")
    if not rest.isEmpty():
        more = _verified(docs, "text", words, percent, rest, met).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = components(linked.unionAll(more), "ngram-components")
    members = cards.where("n_shingles > 0").select("set", "row_id").groupBy("set").agg(F.min("row_id").alias("least"))
    members = members.join(staged(roots, "ngram-roots").select(F.col("node").alias("set"), "root").hint("merge"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    of_set = members.join(least.hint("merge"), "root").select("set", "component")
    full = cards.where("n_shingles > 0").select("row_id", "set", "n_shingles").join(of_set.hint("merge"), "set").select("row_id", "n_shingles", "component")
    empty = cards.where("n_shingles = 0").select("row_id", "n_shingles", F.col("row_id").alias("component"))
    return full.unionAll(empty).select(F.col("row_id").alias(key), "n_shingles", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that with the smallest key. Equal keys all stay."""
    found = jaccard_components(docs, words, percent, key, text).where(~F.col(key).eqNullSafe(F.col("component_id"))).select(key)
    return left_out(docs, staged(found, "ngram-gone"), key)
