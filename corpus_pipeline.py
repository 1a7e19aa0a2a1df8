"""The corpus pipeline: stages of (name, function), each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.lineage import discard, shared_path
from strandmill.llm import decontaminate, language, lines, minhash, pieces
from strandmill.llm.common import shield, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The documents with any further columns out of the way, and the columns that select them all again."""
    return shield(docs, ["doc_id", "text", "lang", "source", "n_chars"], ())


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language the classifier rejects; the others keep their `lang` or, where it is null, get the
    predicted one.

    The classifier learns from the labelled documents themselves.  Null and empty texts and those without a letter have no
    language and go.  Every row is judged by its own text, also where doc_id is null or repeated; a text of any length is read
    whole.  If no document has a label there is nothing to learn from, and every document goes.
    """
    docs, back = apart(docs)
    found = language.predict(docs, language.train(docs)).where("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more share; every document stays, if only with an empty text.

    `n_chars` is counted anew.  Null texts stay null.  Every row is a document, also where doc_id is null or repeated.
    """
    docs, back = apart(docs)
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8).

    Documents without words (null and empty texts too) or without doc_id are no duplicates and stay.  Rows that repeat a
    doc_id are one document and stay or go together.
    """
    docs, back = apart(docs)
    return minhash.near_duplicates(docs).where("kept").select(*back)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage.

    That is any run of 13 words of an item, however long the document is; of an item with fewer words, which may be a common
    phrase, at least a twentieth of the document's words.  Null texts hold nothing and stay.  Every row is judged by its own
    text, also where doc_id is null or repeated.
    """
    docs, back = apart(docs)
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_whole = 0 and not contaminated").select(*back)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and their number; a document that doesn't decode to its own text would fail the job.

    A null text has null tokens, 0 in number; an empty one has the model's first space.  Rows that repeat doc_id and text get
    equal tokens.
    """
    docs, back = apart(docs)
    decoded = pieces.decode(pieces.encode(docs.withColumn("__sha", F.sha2(F.col("text").cast("binary"), 256))))
    same = F.sha2(F.col("decoded").cast("binary"), 256).eqNullSafe(F.col("__sha"))
    checked = F.when(same, F.col("tokens")).otherwise(F.raise_error(F.lit("tokens don't decode to the text")))
    n_tokens = F.coalesce(F.size("tokens"), F.lit(0)).cast("long")
    return decoded.select(*back, checked.alias("tokens"), n_tokens.alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", tokenise),
]

#: Language ID and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's table goes when the next one is written, and the last one is what is read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                discard(spark, before)
            before = path
    return docs
