"""A corpus from raw documents to packed sequences: language, exact copies, near copies, secrets, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all documents that its predecessor kept; all but the
last return the columns of documents. run() writes each stage's rows as Parquet to the cluster's shared
folder and hands them, read again, to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.llm import exact_dedup, langid, near_dup, packing, secrets
from gridwatch.llm.common import bit_split, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject.

    It rejects null texts, texts without a letter and narrow margins; an empty table gives no rows, and one without
    labelled languages loses all. Ties of sizes go to the first language by name, as a margin of zero they are
    rejected. A null doc_id, lang or other column doesn't matter; repeated rows are judged alike; very long texts are judged as a whole, by pieces;
    columns named lang_pred, score or rejected stay as they came."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = langid.identify(docs.select("text", others.alias("others")), langid.fit(docs)).filter("NOT rejected")
    return found.select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns])


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text (A-Z and a-z alike; null counts as empty), one of the largest doc_id.

    A null doc_id is smaller than any other; of rows that repeat the kept doc_id, the first by all columns as JSON
    stays; very long texts are compared as a whole; columns may have any names; an empty table gives no rows."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of the n-gram Jaccard join, the rows of the smallest doc_id.

    Texts without words, empty and null ones stay; so do rows with a null doc_id unless they reach a row that has
    one; rows are told apart by doc_id and text; columns may have any names; very long texts have larger
    sets; an empty table gives no rows. Texts of rows that surely stay aren't moved."""
    found = near_dup.near_duplicates(docs)
    gone = written(found.filter("NOT doc_id <=> component_id").select("doc_id", "text_hash").distinct(), "near-marks")
    maybe, rest = bit_split(docs, F.col("doc_id").cast("long"), gone, "doc_id")
    same = F.col("d.id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.hash") == F.col("g.text_hash"))
    maybe = maybe.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rest.unionByName(maybe.alias("d").join(gone.alias("g"), same, "left_anti").select("row.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars (if the table has it) counted again, as it counts: null for a null text.

    Empty and null texts stay; repeated rows are treated alike; overlapping secrets get one mark; very long texts take time linear in their length; other
    columns pass; an empty table gives no rows."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, packed along the curve.

    Null and empty texts give their end id; repeated rows are each packed; ties on the curve are ordered by doc_id and
    text; a very long text is cut over many sequences; other columns are ignored; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1).drop("ids")


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Compression, shingle components and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
