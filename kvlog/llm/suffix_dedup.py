"""Suffix-array dedup over a logarithmic index family.

Bytes covered by a string of ``length`` bytes that starts at two places or more
are found exactly. Only some suffixes are indexed: in each window of ``length``
bytes, the one whose first ``SEED`` bytes have the smallest hash (the leftmost of
equals). That choice depends on the window's bytes only, so equal windows choose
suffixes at the same place inside them, and about two suffixes in 240 are chosen.
An anchor is a chosen suffix together with the windows that chose it, which start
one after the other, and the bytes that they cover, its reach.

A batch of documents becomes a suffix array: its suffixes in the order of the names
(64-bit hashes) of their first ``SEED`` bytes, then of their whole reach, so those that
begin alike are neighbours, and those that are alike as far as they matter are one
entry with their number, added up before the shuffle. Names take the place of the bytes
themselves, which would be several times the corpus. `SuffixIndex` keeps a family of such
arrays, the levels, in a folder; it can be opened again for later batches. A new batch is
merge-scanned against all levels: the arrays are dealt in ranges of their order and the
sorted streams run together; a run of neighbours with ``SEED`` bytes in common is a match,
and it says whether all of the run are alike to the end of their reach. Runs that go on
where tasks part are put together from one row a task. Then levels of equal size are
merged into one of twice the size, so there are at most log2(batches) levels and an entry
is rewritten as often as that. No run is held in memory, however many suffixes it has.

The matches give each anchor the length it has in common with others: its reach, or
the seed. Reaches that occur twice are repeats as a whole. Where a run has different
reaches, their bytes are fetched, each once, and the windows compared: each
window has 120 bytes or more beside the seed on the right or on the left, so
anchors meet by seed and the 120 bytes on that side, and windows of one offset
that are equal are repeats. Up to ``GROUP`` reaches meet in a task with their bytes;
at the edge of a passage that very many documents share there are more, and of these
only the hashes of the windows are dealt out, counted before the shuffle and joined
back where two reaches have one. No task holds more than ``GROUP`` reaches.

Besides, ``has_repeats`` says whether a document shares a passage with another one:
true if they share ``PASSAGE`` words in a row, false if no ``GRAM`` (in between, as the
choice of words falls). Runs of ``GRAM`` words are names here, of which the smallest of
each ``PASSAGE`` words is indexed. A row repeated in full is no other document.

Reaches and windows are compared by two hashes of 64 bits, that of the seed and their
own. Documents are told apart by id and hash of the text. Those without repeats are
not shuffled; a bitmap of fixed size says which documents have any.

Defined cases: null text has no bytes; texts shorter than ``length`` keep all;
matches never cross documents, but both may be in one; rows repeated in full are
repeats of each other; the kept bytes are binary, as a cut may split a character;
an empty table gives an empty result; columns of the caller that have the names of
the output give way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm import kernels
from kvlog.llm.shared import arrow_schema, bitmap, fresh_path, in_bitmap, staged, unused, without

U64 = np.uint64
LENGTH = 400
SEED = 160
#: Batches that a table is indexed in, and files of anchors beyond which there are more.
BATCHES = 4
BATCH_FILES = 4096
#: Long texts are searched in pieces of this many bytes (and length - 1 more), short ones in blocks.
PIECE = 1 << 17
#: Words that make a passage, and those of a name.
PASSAGE, GRAM = 51, 32
#: Windows whose hashes are held at once while reaches are compared.
WINDOWS = 1 << 18
#: Rows of reaches that are compared in one task, with their bytes.
GROUP = 512
_PLACE_BITS = 22


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each window of so many keys (running minima from both ends of blocks)."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(U64).max, U64)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = kernels._powers(1, len(data))
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(kernels._TABLES[1, False][data] * power[: len(data)], out=prefix[1:])
    return prefix, inverse


def _hash(prefix: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return kernels.mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64))


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, place of the seed, first and last window start, seed hash, reach hash) of each anchor; places count from the block's start."""
    seed = min(SEED, length)
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, U64), np.zeros(0, U64)
    prefix, inverse = _prefix(data)
    at = np.arange(len(data) - seed + 1)
    seeds = _hash(prefix, inverse, at, at + seed)
    keys = (seeds >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | at.astype(U64)
    place = (_least(keys, length - seed + 1) & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.maximum(0, np.diff(offs) - length + 1))
    starts = np.arange(len(text)) - np.searchsorted(text, text) + offs[:-1][text]
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    if not len(first):
        first = last = np.zeros(0, np.int64)
    spot, a, b = place[first], starts[first], starts[last]
    reach = kernels.mix(_hash(prefix, inverse, a, b + length) + (spot - a).astype(U64) * U64(0x9E3779B97F4A7C15))
    return text[first], spot, a, b, seeds[spot], reach


def _pieces(batch: pa.RecordBatch, column: str, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets, place in the text of each piece's start): rows repeat where a long text is cut into overlapping pieces."""
    for rows, data, offs in kernels.blocks(batch, column, PIECE):
        if len(offs) > 2 or len(data) <= PIECE + length:
            yield rows, data, offs, np.zeros(len(offs) - 1, np.int64)
            continue
        for at in range(0, len(data) - length + 1, PIECE):
            part = data[at : at + PIECE + length - 1]
            yield rows, part, np.array([0, len(part)]), np.array([at])


_ANCHOR = "th long, seed long, reach long, place long, first long, last long"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows id, text, th in; anchors out."""
    for batch in batches:
        for rows, data, offs, shift in _pieces(batch, "text", length):
            text, spot, a, b, seed, reach = anchors(data, offs, length)
            base = offs[:-1][text] - shift[text]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(2).take(take), *(pa.array(kernels.signed(x)) for x in (seed, reach)), pa.array(spot - base), pa.array(a - base), pa.array(b - base)], schema=schema)


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """The anchors of documents (id, text, th), as a table."""
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string(_ANCHOR).fields])
    arrow = arrow_schema(docs.sparkSession, schema)
    return staged(docs.select("id", "text", "th").mapInArrow(lambda it: _anchor_rows(it, length, arrow), schema), "suffix-anchors")


class SuffixIndex:
    """The family of levels: arrays (seed, reach, n) in that order, n suffixes each, and what was added, in a folder.

    `save` writes the list of tables as a new generation; opening the folder reads the
    last one, so a batch that was cut short isn't in it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or fresh_path(spark, "suffix-index")
        self.levels: list[tuple[int, str]] = []  # (batches inside, folder of the array)
        self.texts: list[str] = []
        self.anchors: list[str] = []
        self.generation = 0
        fs, where = self._fs(f"{self.path}/family")
        if fs.exists(where):
            rows = spark.read.parquet(f"{self.path}/family").orderBy("place").collect()  # a few rows for each generation
            self.generation = max(r["generation"] for r in rows)
            last = [r for r in rows if r["generation"] == self.generation]
            self.levels = [(r["size"], r["folder"]) for r in last if r["kind"] == "level"]
            self.texts, self.anchors = ([r["folder"] for r in last if r["kind"] == k] for k in ("texts", "anchors"))

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def save(self) -> None:
        self.generation += 1
        rows = [("level", size, folder) for size, folder in self.levels] + [(k, 0, f) for k, folders in (("texts", self.texts), ("anchors", self.anchors)) for f in folders]
        table = self.spark.createDataFrame([(self.generation, i, *r) for i, r in enumerate(rows)], "generation int, place int, kind string, size int, folder string")
        table.coalesce(1).write.mode("append").parquet(f"{self.path}/family")

    def put(self, df: DataFrame, what: str) -> str:
        folder = f"{self.path}/{what}-{self.generation + 1}-{len(self.levels)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        return folder

    def table(self, *folders: str) -> DataFrame:
        return self.spark.read.parquet(*folders)

    def _array(self, entries: DataFrame) -> str:
        """Equal suffixes become one entry before they are shuffled, and entries are put in order."""
        return self.put(entries.groupBy("seed", "reach").agg(F.sum("n").alias("n")).sortWithinPartitions("seed", "reach"), "level")

    def add(self, batch: DataFrame) -> DataFrame:
        """Scan a batch (seed, reach) against the levels and itself, then merge it in; returns its matches (seed, mixed: whether reaches differ) as a table."""
        array = self._array(batch.select("seed", "reach", F.lit(1).cast("long").alias("n")))
        together = self.table(array).select("seed", "reach", "n", F.lit(1).cast("long").alias("new"))
        if self.levels:
            together = together.unionAll(self.table(*(folder for _, folder in self.levels)).select("seed", "reach", "n", F.lit(0).cast("long").alias("new")))
        runs = together.repartitionByRange("seed", "reach").sortWithinPartitions("seed", "reach").mapInArrow(_runs_of, "seed long, n long, new long, least long, most long, edge boolean")
        runs = self.table(self.put(runs, "runs"))
        # a run that goes on in the next task has a row in each
        parted = runs.where("edge").groupBy("seed").agg(F.sum("n").alias("n"), F.max("new").alias("new"), F.min("least").alias("least"), F.max("most").alias("most"))
        met = runs.where("NOT edge").drop("edge").unionByName(parted).where("n > 1 AND new > 0").select("seed", F.expr("least <> most").alias("mixed"))
        size, merged = 1, [array]
        while self.levels and self.levels[-1][0] == size:
            merged.append(self.levels.pop()[1])
            size *= 2
        self.levels.append((size, self._array(self.table(*merged)) if len(merged) > 1 else array))
        return staged(met, "suffix-met")


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries (seed, reach, n, new) in order: a row for each run of one seed that isn't alone; the first and the last run may go on in other tasks (edge)."""
    names = ["seed", "n", "new", "least", "most", "edge"]
    last, edge = None, True  # figures of the run that may go on, and whether it is the task's first

    def rows(seed, n, new, least, most, edge) -> pa.RecordBatch:
        on = (n > 1) | edge
        return pa.RecordBatch.from_arrays([*(pa.array(x[on]) for x in (seed, n, new, least, most)), pa.array(edge[on])], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        seed, reach, n, new = (batch.column(c).to_numpy() for c in range(4))
        at = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        figures = [seed[at], np.add.reduceat(n, at), np.maximum.reduceat(new, at), np.minimum.reduceat(reach, at), np.maximum.reduceat(reach, at)]
        if last is not None:
            if last[0] == figures[0][0]:
                for x, w, f in zip(figures[1:], last[1:], (np.add, np.maximum, np.minimum, np.maximum), strict=True):
                    x[0] = f(x[0], w)
            else:
                figures = [np.concatenate([[w], x]) for w, x in zip(last, figures, strict=True)]
        last = [x[-1] for x in figures]
        if len(figures[0]) > 1:
            first = np.zeros(len(figures[0]) - 1, bool)
            first[0], edge = edge, False
            yield rows(*(x[:-1] for x in figures), first)
    if last is not None:
        yield rows(*(np.array([w]) for w in last), np.array([True]))


_BESIDE = "key long, seed long, reach long, right boolean, before long, bytes binary"


def _reaches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, place, first, last, seed, reach), a document's text before its anchors: the bytes of the reaches, by the seed and what is beside it on either side."""
    seed_size = min(SEED, length)
    side = -(-(length - seed_size) // 2)
    raw, prefix, inverse = b"", None, None
    for batch in batches:
        text = batch.column(0)
        heads = text.is_valid().to_numpy(zero_copy_only=False)
        out = [[] for _ in range(6)]
        held = 0
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)):
            if heads[i]:
                raw, prefix = text[i].as_py().encode(), None
                continue
            spot, a, b, seed, reach = row
            if prefix is None:
                prefix, inverse = _prefix(np.frombuffer(raw, np.uint8))
            for right in (True, False):
                lo, hi = (spot, spot + seed_size + side) if right else (spot - side, spot + seed_size)
                if hi <= b + length if right else lo >= a:
                    key = kernels.mix(_hash(prefix, inverse, np.array([lo]), np.array([hi])) ^ U64(right)).view(np.int64)[0]
                    for column, value in zip(out, (key, seed, reach, right, spot - a, raw[a : b + length]), strict=True):
                        column.append(value)
                    held += b + length - a
            if held > 1 << 22:
                yield _beside(out)
                out, held = [[] for _ in range(6)], 0
        yield _beside(out)


def _beside(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "seed", "reach", "right", "before", "bytes"])


def _with_bit(batches: Iterator[pa.RecordBatch], bits: Broadcast, place: int, on: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose hash in a column has (or hasn't) its bit set."""
    for batch in batches:
        yield batch.filter(pa.array(in_bitmap(bits.value, batch.column(place).to_numpy()) == on))


def _windows(raw: bytes, before: int, right: bool, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A reach's bytes and its windows with the seed and that side of it inside: offsets of the seed in them, and their starts."""
    side = -(-(length - min(SEED, length)) // 2)
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(len(data) - length + 1)
    # offsets of the seed in a window: up to length - seed - side with the right side inside, side or more with the left
    starts = starts[(before - starts <= length - min(SEED, length) - side)] if right else starts[before - starts >= side]
    return before - starts, starts, data


def _window_hashes(offset: np.ndarray, starts: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    prefix, inverse = _prefix(data)
    return kernels.mix(_hash(prefix, inverse, starts, starts + length) + offset.astype(U64) * U64(0x632BE59BD9B4E019))


def _repeated(group: list[tuple[int, int, bool, int, bytes]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(seed, reach, from, to): runs of window starts, counted from the reach's start, that another reach of the group has."""
    hashed = [_windows(raw, before, right, length) for _, _, right, before, raw in group]
    offsets = [h[0] for h in hashed]
    top = max((int(o.max()) for o in offsets if len(o)), default=-1)
    step = max(1, WINDOWS // len(group))
    flags = [np.zeros(len(h[1]), bool) for h in hashed]
    for lo in range(0, top + 1, step):
        keys, owners = [], []
        for i, (offset, starts, data) in enumerate(hashed):
            at = np.flatnonzero((offset >= lo) & (offset < lo + step))
            if len(at):
                keys.append(_window_hashes(offset[at], starts[at], data, length))
                owners.append(np.stack([np.full(len(at), i), at]))
        if not keys:
            continue
        key, owner = np.concatenate(keys), np.concatenate(owners, axis=1)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i, at in owner[:, twice].T:
            flags[i][at] = True
    for (seed, reach, _, _, _), (_, starts, _), flag in zip(group, hashed, flags, strict=True):
        if flag.any():
            on = starts[flag]
            cut = np.flatnonzero(np.diff(on) != 1) + 1
            for run in np.split(on, cut):
                yield seed, reach, int(run[0]), int(run[-1])


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and reach; a reach that comes again is passed over."""
    key, group = None, []

    def out() -> pa.RecordBatch:
        rows = list(_repeated(group, length)) if len(group) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["seed", "reach", "lo", "hi"])

    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if k != key:
                if len(group) > 1:
                    yield out()
                key, group = k, []
            if not group or group[-1][:2] != tuple(row[:2]):
                group.append(tuple(row))
    if len(group) > 1:
        yield out()


def _spread(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of a reach: its hash, and where it starts in the reach."""
    for batch in batches:
        for i in range(0, batch.num_rows, GROUP):
            some = batch.slice(i, GROUP)
            found = [_windows(raw.as_py(), before.as_py(), right.as_py(), length) for right, before, raw in zip(*(some.column(c) for c in (3, 4, 5)), strict=True)]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            hashes = np.concatenate([np.zeros(0, U64), *(_window_hashes(*f, length) for f in found)])
            starts = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
            yield pa.RecordBatch.from_arrays([pa.array(kernels.signed(hashes)), some.column(1).take(take), some.column(2).take(take), pa.array(starts)], ["window", "seed", "reach", "at"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seed, reach, sorted starts) as runs (seed, reach, from, to)."""
    for batch in batches:
        rows = []
        for seed, reach, starts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            on = np.array(starts)
            rows += [(seed, reach, int(run[0]), int(run[-1])) for run in np.split(on, np.flatnonzero(np.diff(on) != 1) + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["seed", "reach", "lo", "hi"])


def _large(beside: DataFrame) -> Broadcast:
    """A bitmap of the keys with more than GROUP rows (and of those that share a bit with them)."""
    return beside.sparkSession.sparkContext.broadcast(bitmap(beside.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP), "key"))


def _parts(beside: DataFrame, length: int) -> DataFrame:
    """(seed, reach, lo, hi): runs of window starts that another reach has."""
    runs = "seed long, reach long, lo long, hi long"
    large = _large(beside)
    few = beside.mapInArrow(lambda it: _with_bit(it, large, 0, False), beside.schema)
    few = few.repartition("key").sortWithinPartitions("key", "reach").mapInArrow(lambda it: _compare(it, length), runs)
    # tables of their own, so that the join on a window that very many reaches have can be split
    windows = staged(beside.mapInArrow(lambda it: _spread(_with_bit(it, large, 0, True), length), "window long, seed long, reach long, at long"), "suffix-windows")
    twice = staged(windows.groupBy("seed", "window").agg(F.min("reach").alias("a"), F.max("reach").alias("b")).where("a <> b").select("seed", "window"), "suffix-twice")
    again = windows.join(twice.hint("merge"), ["seed", "window"], "left_semi").groupBy("seed", "reach").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    return few.unionAll(again.mapInArrow(_runs, runs)).distinct()


def _bytes_of(docs: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """The bytes of anchors (id, th, place, first, last, seed, reach), from the documents that hold them."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(anchors, "th"))
    spot = ["place", "first", "last", "seed", "reach"]
    holders = docs.select("id", "th", "text").mapInArrow(lambda it: _with_bit(it, bits, 1, True), docs.select("id", "th", "text").schema)
    rows = holders.select("id", "th", "text", *(F.lit(None).cast("long").alias(c) for c in spot)).unionAll(anchors.select("id", "th", F.lit(None).cast("string").alias("text"), *spot))
    rows = rows.repartition("id", "th").sortWithinPartitions("id", "th", F.col("text").isNull())
    return rows.select("text", *spot).mapInArrow(lambda it: _reaches(it, length), _BESIDE)


def _spans(docs: DataFrame, every: DataFrame, met: DataFrame, length: int) -> DataFrame:
    """(id, th, spans) of the documents (id, text, th) that have repeats; every anchor, and the matches of the index."""
    # tables of their own, so that a join on a seed or reach with very many anchors can be split
    met = staged(met.groupBy("seed").agg(F.max("mixed").alias("mixed")), "suffix-seeds")
    at = staged(every.join(met.hint("merge"), "seed"), "suffix-matches")
    one = F.min(F.struct("id", "th", "place", "first", "last")).alias("one")
    reaches = staged(at.groupBy("seed", "reach").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), one), "suffix-reaches")
    differing = staged(reaches.where("mixed").select("one.*", "seed", "reach"), "suffix-differing")
    parts = staged(_parts(staged(_bytes_of(docs, differing, length), "suffix-beside"), length), "suffix-parts")
    whole = staged(reaches.where("n > 1").select("seed", "reach"), "suffix-whole")
    of_whole = at.join(whole.hint("merge"), ["seed", "reach"], "left_semi").select("id", "th", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    of_parts = at.where("mixed").join(parts.hint("merge"), ["seed", "reach"]).select("id", "th", (F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + length).alias("b"))
    return of_whole.unionAll(of_parts).groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


# -- passages -----------------------------------------------------------------


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text, own in; (name, own) out: the smallest run of GRAM words in each PASSAGE words of a text."""
    width = PASSAGE - GRAM + 1
    for batch in batches:
        for rows, data, offs in kernels.blocks(batch, "text", PIECE):
            starts, ends, first = kernels.words(data, offs)
            grams, at = kernels.windows(kernels.span_hashes(data, starts, ends), first, GRAM)
            text = np.repeat(np.arange(len(offs) - 1), np.maximum(0, np.diff(at) - width + 1))
            if not len(text):
                continue
            places = np.arange(len(text)) - np.searchsorted(text, text) + at[:-1][text]
            least = _least(grams, width)[places]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(kernels.signed(least[new])), rows.column(1).take(pa.array(text[new]))], ["name", "own"])


def _sharing(docs: DataFrame) -> DataFrame:
    """own, of the documents (text, own) that share a passage with another."""
    names = staged(docs.select("text", "own").mapInArrow(_names, "name long, own long"), "suffix-names")
    met = staged(names.groupBy("name").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("name"), "suffix-passages")
    return names.join(met.hint("merge"), "name", "left_semi").select("own").distinct()


# -- results ------------------------------------------------------------------


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = F.coalesce(text, F.lit(""))
    return docs.select(F.col(key).alias("id"), own.alias("text"), F.xxhash64(own).alias("th"))


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The last two columns, text and spans, become the bytes kept, and the numbers of bytes and runs removed."""
    for batch in batches:
        kept, removed, count = [], [], []
        for t, found in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
            raw, end, pieces, gone, runs = t.as_py().encode(), 0, [], 0, 0
            for span in found.as_py() or ():
                a, b = span["a"], span["b"]
                if a > end or not runs:
                    pieces.append(raw[end:a])
                    runs += 1
                    end = a
                if b > end:
                    gone += b - end
                    end = b
            pieces.append(raw[end:])
            kept.append(b"".join(pieces))
            removed.append(gone)
            count.append(runs)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], schema=schema)


def _result(docs: DataFrame, spans: DataFrame, sharing: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    docs = without(docs, "kept_bytes", "n_bytes", "n_removed", "n_spans", "has_repeats")
    rest = [c for c in docs.columns if c != text]
    own = F.coalesce(text, F.lit(""))
    # id, hash and whether a passage is shared of the documents that have anything; the others aren't shuffled
    shared = _slim(docs, key, text).select("id", "th", F.xxhash64("id", "th").alias("own")).join(sharing.hint("merge"), "own", "left_semi").select("id", "th").distinct()
    found = spans.select("id", "th", "spans", F.lit(False).alias("shares")).unionAll(shared.select("id", "th", F.lit(None).cast(spans.schema["spans"].dataType), F.lit(True)))
    found = staged(found.groupBy("id", "th").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("shares").alias("shares")), "suffix-spans")
    have = spark.sparkContext.broadcast(bitmap(found, "th"))
    th, i, h, s, r = (unused(docs, n) for n in ("th", "i", "h", "s", "r"))
    full = docs.select(*rest, own.alias(text), F.xxhash64(own).alias(th))
    place = len(full.columns) - 1
    clean, touched = (full.mapInArrow(lambda it, on=on: _with_bit(it, have, place, on), full.schema) for on in (False, True))
    n_bytes = F.octet_length(text).cast("long").alias("n_bytes")
    zero = lambda n: F.lit(0).cast("long").alias(n)
    clean = clean.select(*rest, n_bytes, F.lit(False).alias("has_repeats"), F.encode(text, "utf-8").alias("kept_bytes"), zero("n_removed"), zero("n_spans"))
    found = found.select(F.col("id").alias(i), F.col("th").alias(h), F.col("spans").alias(s), F.col("shares").alias(r))
    touched = touched.join(found.hint("merge"), touched[key].eqNullSafe(F.col(i)) & (touched[th] == F.col(h)), "left")
    touched = touched.select(*rest, n_bytes, F.coalesce(r, F.lit(False)).alias("has_repeats"), text, s)
    schema = T.StructType([*touched.schema.fields[:-2], T.StructField("kept_bytes", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
    arrow = arrow_schema(spark, schema)
    return clean.unionByName(touched.mapInArrow(lambda it: _cut(it, arrow), schema))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", n_batches: int = BATCHES) -> DataFrame:
    """docs with kept_bytes (binary), n_bytes, n_removed, n_spans and has_repeats, and without the text column."""
    spark = docs.sparkSession
    slim = _slim(docs, key, text)
    every = anchor_table(slim, length)
    files = sorted(every.inputFiles())
    n_batches = max(n_batches, -(-len(files) // BATCH_FILES))
    index, met = SuffixIndex(spark), None
    for b in range(n_batches):
        if own := files[b::n_batches]:
            found = index.add(spark.read.schema(every.schema).parquet(*own))
            met = found if met is None else met.unionAll(found)
    if met is None:
        met = spark.createDataFrame([], "seed long, mixed boolean")
    sharing = _sharing(slim.select("text", F.xxhash64("id", "th").alias("own")))
    return _result(docs, _spans(slim, every, met, length), sharing, key, text)


def add_documents(index: SuffixIndex, docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A later batch: it is added to an index in a folder, and comes back without what is in earlier batches or twice in itself, as from `remove_repeats`."""
    slim = _slim(docs, key, text)
    index.texts.append(index.put(slim, "texts"))
    batch = index.put(anchor_table(index.table(index.texts[-1]), length), "anchors")
    index.anchors.append(batch)
    met = index.add(index.table(batch))
    index.save()
    every, texts = index.table(*index.anchors), index.table(*index.texts)
    sharing = _sharing(texts.select("text", F.xxhash64("id", "th").alias("own")))
    return _result(docs, _spans(texts, every, met, length), sharing, key, text)
