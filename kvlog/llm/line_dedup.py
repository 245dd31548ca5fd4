r"""Line dedup with a sharded minimal perfect hash.

1. Every whole text is split at \n. A line's key (white space stripped at both
   ends, A-Z lower-cased) becomes 128 bits. Tasks count keys once a document and
   Spark adds the counts up, partially before the shuffle: a line in a third of
   all documents arrives as one row a task.
2. The distinct keys are dealt into shards by hash. A shard is a minimal perfect
   hash (levels of bit arrays with ranks) over its keys, with two arrays at the
   key's rank: 64-bit fingerprints and saturating counts. A shard holds about
   ``SHARD_KEYS`` keys, so more lines make more shards, not larger ones.
3. Documents probe: each distinct key of a document goes to its shard (16 bytes
   and the doc id, no line text). How many probes a shard gets is known from its
   counts; one that gets more than ``PROBES`` (a line of a third of all documents is
   in it, say) is copied, and its probes are dealt over the copies. At most
   ``HOT_SHARDS`` shards are: beyond 2**35 probes the bound grows with their number.
   A task streams a shard and its probes, so it holds one shard and one batch. Hits
   come back as one short list for each document that loses lines; no lines are joined.
4. The texts are joined with their lists by merging, at any size, since the lists
   grow with the corpus, and rewritten.

Defined cases: null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; a document is a row, so repeated
rows count each; null ids are ids like any other; an empty table gives an empty
result. Columns n_lines and n_dropped of the caller give way; others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlog.llm import kernels
from kvlog.llm.shared import arrow_schema, staged, unused, without

SHARD_KEYS = 1 << 18
#: Probes of one copy of a shard.
PROBES = 1 << 19
HOT_SHARDS = 1 << 16
COUNT_MAX = 65535
U64 = np.uint64
_GAMMA = 2.0
_MAX_LEVELS = 40


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: each level keeps the keys that are alone in their slot."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        before, self.ranks = 0, []
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.concatenate([[0], np.cumsum(counts)]))
            before += int(counts.sum())
        self.size = before

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (kernels.mix(keys + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == _MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, int(len(keys) * _GAMMA) + 63 & ~63)
            slots = cls._slots(keys, len(levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(U64))
            keys = keys[~alone[slots]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key; any rank or -1 for a key that isn't in the set."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            slots = self._slots(keys[rest], level, len(bits) * 64)
            word, bit = slots >> 6, (slots & 63).astype(U64)
            here = bits[word] >> bit & U64(1) == 1
            below = np.bitwise_count(bits[word] & ((U64(1) << bit) - U64(1)))
            out[rest[here]] = (self.ranks[level][word] + below)[here]
            rest = rest[~here]
            if not len(rest):
                break
        return out

    def dump(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], U64).tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, U64, 1)[0])
        sizes = np.frombuffer(raw, U64, n, 8).astype(int)
        at, levels = 8 * (n + 1), []
        for size in sizes:
            levels.append(np.frombuffer(raw, U64, size, at))
            at += 8 * int(size)
        return cls(levels)


def _keys(data: np.ndarray, offs: np.ndarray, min_chars: int):
    starts, ends, first = kernels.lines(data, offs)
    s, e = kernels.stripped(data, starts, ends)
    long = kernels.code_points(data, s, e) >= min_chars if min_chars > 0 else np.ones(len(s), bool)
    return starts, ends, first, kernels.span_hashes(data, s, e, 1, True), kernels.span_hashes(data, s, e, 2, True), long


def _distinct(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indexes of the first of each (doc, h1, h2); two different keys with one h1 stay two."""
    order = np.lexsort((h2, h1, doc))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    return order[new]


def _count(batches: Iterator[pa.RecordBatch], text: str, min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offs in kernels.blocks(batch, text):
            _, _, first, h1, h2, long = _keys(data, offs, min_chars)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            h1, h2, doc = h1[long], h2[long], doc[long]
            pick = _distinct(h1, h2, doc)
            h1, h2 = h1[pick], h2[pick]
            order = np.lexsort((h2, h1))
            h1, h2 = h1[order], h2[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(kernels.signed(h1[at])), pa.array(kernels.signed(h2[at])), pa.array(np.diff(np.append(at, len(h1))))], ["h1", "h2", "n"])


_SHARD = "shard int, probes long, by_h1 boolean, hash binary, fingerprints binary, counts binary"
_SHARD_ARROW = pa.schema([("shard", pa.int32()), ("probes", pa.int64()), ("by_h1", pa.bool_()), ("hash", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary())])


def _shard(of: pa.Table) -> pa.Table:
    """One row: the shard's number of probes, perfect hash, fingerprints and counts."""
    h1, h2, n = (of.column(c).to_numpy() for c in ("h1", "h2", "n"))
    key = kernels.mix(h1.view(U64) ^ kernels.mix(h2.view(U64)))
    by_h1 = len(np.unique(key)) < len(key)
    if by_h1:  # 64 bits met; the 128 behind them are distinct, so such keys are told apart by h1 alone
        key = h1.view(U64)
    hashed = PerfectHash.build(key)
    at = hashed.index(key)
    fingerprint, count = np.zeros(len(key), U64), np.zeros(len(key), np.uint16)
    fingerprint[at] = h2.view(U64)
    count[at] = np.minimum(n, COUNT_MAX)
    return pa.table({"shard": of.column("shard")[:1], "probes": [int(n.sum())], "by_h1": [by_h1], "hash": [hashed.dump()], "fingerprints": [fingerprint.tobytes()], "counts": [count.tobytes()]}, schema=_SHARD_ARROW)


def _probes(batches: Iterator[pa.RecordBatch], key: str, text: str, min_chars: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in kernels.blocks(batch, text):
            _, _, first, h1, h2, long = _keys(data, offs, min_chars)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            h1, h2, doc = h1[long], h2[long], doc[long]
            pick = _distinct(h1, h2, doc)
            yield pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(doc[pick])), pa.array(kernels.signed(h1[pick])), pa.array(kernels.signed(h2[pick]))], schema=schema)


class _Shard:
    """A shard as the probes see it."""

    def __init__(self, row: dict) -> None:
        self.by_h1, self.hash = row["by_h1"], PerfectHash.load(row["hash"])
        self.fingerprints, self.counts = np.frombuffer(row["fingerprints"], U64), np.frombuffer(row["counts"], np.uint16)

    def hits(self, h1: np.ndarray, h2: np.ndarray, min_docs: int) -> np.ndarray:
        at = self.hash.index(h1 if self.by_h1 else kernels.mix(h1 ^ kernels.mix(h2)))
        return (at >= 0) & (self.fingerprints[at] == h2) & (self.counts[at] >= min_docs)


def _probe(batches: Iterator[pa.RecordBatch], min_docs: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (shard, salt, id, h1, h2, arrays), sorted by shard and salt with the row of the arrays first: the probes that hit."""
    shard = None
    for batch in batches:
        arrays = batch.column(5)
        heads = np.flatnonzero(arrays.is_valid().to_numpy(zero_copy_only=False))
        for a, b in zip([0, *heads], [*heads, batch.num_rows], strict=True):
            if a in heads:
                shard = _Shard(arrays[int(a)].as_py())
                a += 1
            if a < b:
                part = batch.slice(a, b - a)
                h1, h2 = (part.column(c).to_numpy().view(U64) for c in (3, 4))
                on = pa.array(shard.hits(h1, h2, min_docs))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(on) for c in (2, 3, 4)], schema=schema)


def _rewrite(batches: Iterator[pa.RecordBatch], text: str, min_chars: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in kernels.blocks(batch, text):
            starts, ends, first, h1, h2, long = _keys(data, offs, min_chars)
            gone = rows.column(rows.num_columns - 1).to_pylist()
            raw = data.tobytes()
            kept, dropped = [], []
            for i in range(len(offs) - 1):
                a, b = first[i], first[i + 1]
                if not gone[i]:
                    kept.append(raw[offs[i] : offs[i + 1]])
                    dropped.append(0)
                    continue
                pairs = {(x["h1"], x["h2"]) for x in gone[i]}
                own = zip(h1[a:b].view(np.int64).tolist(), h2[a:b].view(np.int64).tolist(), strict=True)
                out = long[a:b] & np.fromiter((x in pairs for x in own), bool, b - a)
                kept.append(b"\n".join(raw[starts[j] : ends[j]] for j in range(a, b) if not out[j - a]))
                dropped.append(int(out.sum()))
            place = rows.schema.get_field_index(text)
            old = [rows.column(c) if c != place else pa.array(kept, pa.binary()).cast(pa.string()) for c in range(rows.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*old, pa.array(np.diff(first)), pa.array(dropped, pa.int64())], schema=schema)


def _salted(shards: DataFrame, probes: DataFrame, copies: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Both with salt: the shards once for each of their copies, each probe for one; copies has (shard, number) of those with more than one."""
    of = F.lit(1)
    if copies:
        table = probes.sparkSession.createDataFrame(copies, "shard int, copies int")
        shards, probes = (df.join(F.broadcast(table), "shard", "left") for df in (shards, probes))
        of = F.coalesce("copies", F.lit(1))
    return shards.withColumn("salt", F.explode(F.sequence(F.lit(0), of - 1))), probes.withColumn("salt", F.pmod(F.xxhash64("id", "h1"), of).cast("int"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, key: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS, probes_each: int = PROBES) -> DataFrame:
    """docs with the lines of keys in at least min_docs documents gone, plus n_lines (before) and n_dropped."""
    if not 0 < min_docs <= COUNT_MAX:
        raise ValueError(f"min_docs must be 1 to {COUNT_MAX}, where counts saturate")
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    counts = slim.select("t").mapInArrow(lambda it: _count(it, "t", min_chars), "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    counts = staged(counts, "line-counts")
    sizes = counts.agg(F.count("*").alias("keys"), F.sum("n").alias("probes")).first()
    n_shards = max(1, -(-sizes["keys"] // shard_keys))
    shard = F.pmod(F.col("h1"), F.lit(n_shards)).cast("int").alias("shard")
    shards = staged(counts.select(shard, "h1", "h2", "n").groupBy("shard").applyInArrow(_shard, _SHARD), "line-shards")
    most = max(probes_each, -(-(sizes["probes"] or 0) // HOT_SHARDS))
    hot = shards.where(F.col("probes") > most).select("shard", F.ceil(F.col("probes") / most).cast("int").alias("copies"))
    id_type = docs.schema[key].dataType
    hit_schema = T.StructType([T.StructField("id", id_type), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    arrow = arrow_schema(spark, hit_schema)
    probes = slim.mapInArrow(lambda it: _probes(it, "id", "t", min_chars, arrow), hit_schema).select(shard, "id", "h1", "h2")
    shards, probes = _salted(shards, probes, [tuple(r) for r in hot.collect()])  # at most HOT_SHARDS rows
    arrays = F.struct("by_h1", "hash", "fingerprints", "counts")
    rows = shards.select("shard", "salt", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), arrays.alias("arrays"))
    kind = rows.schema["arrays"].dataType
    rows = rows.unionAll(probes.select("shard", "salt", "id", "h1", "h2", F.lit(None).cast(kind)))
    rows = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
    hits = rows.mapInArrow(lambda it: _probe(it, min_docs, arrow), hit_schema)
    own, gone = unused(docs, "id"), unused(docs, "gone")
    lists = hits.groupBy(F.col("id").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    joined = docs.join(staged(lists, "line-hits").hint("merge"), docs[key].eqNullSafe(F.col(own)), "left").drop(own)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    arrow_out = arrow_schema(spark, schema)
    return joined.mapInArrow(lambda it: _rewrite(it, text, min_chars, arrow_out), schema)
