r"""Quality rules: word rules plus compression bands.

Every whole text is compressed with zstandard as a whole, and in fixed chunks of
``CHUNK`` and of ``SMALL_CHUNK`` bytes. The ratio raw / compressed has to lie inside
a band that depends on the length, since short texts compress less: above the band
the text is repetitive, below it incompressible (base64, random symbols). One chunk
outside its band rejects the document, so a long ordinary text can't hide a
repetitive passage of a chunk or more. The last chunk ends with the text and may
overlap the one before, so tails are judged too; texts shorter than a small chunk
are judged as a whole by the band for their length.

From 512 bytes on the lower limits are above base64 of that length (1.33 at most);
in shorter texts ordinary words compress hardly better. A ratio grows with the length of
a text, so bands are half an octave wide, and the upper limits lie 2 to 6 percent above
the largest ratio of the texts of that length that labels call good (20,149 that pass the
word rules, in four languages). That is tight enough to reject texts whose words carry
trailing symbols, which no word rule notices. Corpora of another kind need their own
bands; all of them are parameters.

Defined cases: null or empty text has no words, ratio null and fails the word
rule; texts shorter than the smallest band's start have no ratio verdict; repeated
rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kvlog.llm import kernels
from kvlog.llm.shared import arrow_schema, without

CHUNK = 4096
SMALL_CHUNK = 1024
LEVEL = 3
#: From this many bytes on: smallest and largest ratio of a whole text.
BANDS = (
    (64, 0.85, 1.9),
    (128, 1.0, 1.95),
    (256, 1.2, 1.95),
    (362, 1.25, 2.0),
    (512, 1.35, 2.02),
    (724, 1.4, 2.07),
    (1024, 1.5, 2.12),
    (1448, 1.55, 2.22),
    (2048, 1.6, 2.26),
    (2896, 1.65, 2.3),
    (4096, 1.7, 2.42),
    (5793, 1.75, 2.48),
    (8192, 1.8, 2.53),
    (11585, 1.8, 2.56),
    (16384, 1.85, 2.63),
    (32768, 1.85, 2.7),
    (65536, 1.9, 2.8),
    (262144, 1.9, 3.0),
)
#: Width of a chunk, smallest and largest ratio.
CHUNK_BANDS = ((CHUNK, 1.7, 2.4), (SMALL_CHUNK, 1.45, 2.08))
SYMBOLS = b"#*$%&|<>"
OUTPUT = (
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("zstd_ratio", T.DoubleType()),
    ("worst_chunk_ratio", T.DoubleType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeats(hashes: np.ndarray, width: int) -> int:
    """Words inside windows whose hash is there twice or more."""
    if len(hashes) < 2:
        return 0
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(hashes) + width, np.int64)
    start = np.zeros(len(hashes), bool)
    start[order[1:][same]] = True
    start[order[:-1][same]] = True
    at = np.flatnonzero(start)
    np.add.at(again, at, 1)
    np.add.at(again, at + width, -1)
    return int((np.cumsum(again) > 0).sum())


def compression(raw: bytes, compressor: zstandard.ZstdCompressor, bands=BANDS, chunk_bands=CHUNK_BANDS) -> tuple[float | None, float | None, bool]:
    """Ratio of the whole, the chunk ratio farthest from its band's middle, and whether all lie inside their bands."""
    size = len(raw)
    if not size:
        return None, None, True
    whole = size / len(compressor.compress(raw))
    ok = all(lo <= whole <= hi for start, lo, hi in [b for b in bands if b[0] <= size][-1:])
    worst, off = None, -1.0
    for width, lo, hi in chunk_bands:
        if size < width:
            continue
        middle = (lo * hi) ** 0.5
        # the last one ends with the text
        for at in (*range(0, size - width, width), size - width):
            ratio = width / len(compressor.compress(raw[at : at + width]))
            ok = ok and lo <= ratio <= hi
            if (away := max(ratio / middle, middle / ratio)) > off:
                worst, off = ratio, away
    return whole, worst, ok


def _judge(batches: Iterator[pa.RecordBatch], text: str, min_words: int, max_repeat_percent: int, bands: tuple, chunk_bands: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    for batch in batches:
        for rows, data, offs in kernels.blocks(batch, text):
            starts, ends, first = kernels.words(data, offs)
            n_words = np.diff(first)
            ink = ~kernels.SPACE[data]
            word_chars = kernels.per_text(ink & ((data & 0xC0) != 0x80), offs)
            symbols = kernels.per_text(_SYMBOL[data], offs)
            grams, gram_first = kernels.windows(kernels.span_hashes(data, starts, ends), first, 3)
            l_starts, l_ends, l_first = kernels.lines(data, offs)
            l_hash = kernels.span_hashes(data, l_starts, l_ends)
            l_words = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
            raw = data.tobytes()
            columns = [[] for _ in range(5)]
            for i in range(len(offs) - 1):
                keys = l_hash[l_first[i] : l_first[i + 1]][l_words[l_first[i] : l_first[i + 1]]]
                dup = len(keys) - len(np.unique(keys)) if len(keys) > 1 else 0
                repeat = _repeats(grams[gram_first[i] : gram_first[i + 1]], 3)
                whole, worst, ok = compression(raw[offs[i] : offs[i + 1]], compressor, bands, chunk_bands)
                for c, v in zip(columns, (dup, repeat, whole, worst, ok), strict=True):
                    c.append(v)
            failed = (n_words < min_words) | (100 * np.array(columns[1]) > max_repeat_percent * n_words)
            new = [n_words, word_chars, symbols, columns[0], columns[1], columns[2], columns[3], failed, ~failed & np.array(columns[4], bool)]
            old = [rows.column(n) for n in schema.names[: -len(new)]]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(v, type=f.type) for v, f in zip(new, list(schema)[-len(new) :], strict=True))], schema=schema)


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, bands: tuple = BANDS, chunk_bands: tuple = CHUNK_BANDS) -> DataFrame:
    """The rows of docs with the measures and verdicts of OUTPUT; columns of docs with such a name give way."""
    docs = without(docs, *(n for n, _ in OUTPUT if n.lower() != text.lower()))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in OUTPUT)])
    arrow = arrow_schema(docs.sparkSession, schema)
    return docs.mapInArrow(lambda it: _judge(it, text, min_words, max_repeat_percent, bands, chunk_bands, arrow), schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    names = docs.columns
    marked = docs.selectExpr("struct(*) AS row", f"`{text}` AS text")
    return quality_rules(marked).where("kept").select(*[f"row.`{c}`" for c in names])
