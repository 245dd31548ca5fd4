"""The corpus pipeline: documents through five of the corpus operators, each stage on all its predecessor kept.

Every stage takes documents (doc_id, text and any other columns, whose values it leaves
alone whatever their names) and returns the same columns; the last adds its own. An
empty table stays empty. Null texts count as empty ones, which the first stage rejects;
stages that are called by themselves keep them. Rows repeated in full are kept or
dropped together, but for the n-gram join, see there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm import decontamination, line_dedup, ngram_join, pieces, quality_rules
from kvlog.llm.shared import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: too few words, repeated words, or a compression ratio outside its band."""
    return quality_rules.keep_good(docs)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; n_chars, if there is such a column, follows the text. No document goes; one whose lines all go has an empty text."""
    names = docs.columns
    rest = F.struct(F.lit(0).alias("_"), *(c for c in names if c not in ("doc_id", "text")))
    out = line_dedup.drop_common_lines(docs.select("doc_id", "text", rest.alias("rest")))
    out = out.select(*(c if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in names))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest id stays; rows of one id stay or go together. Texts without words are in no group."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its errors, go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the scores of the n best segmentations, with the text that decoding gives back; columns of these names give way."""
    return pieces.encode_nbest(docs, decoded="decoded")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", common_lines),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL has no zstandard, edit distance or piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
