"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Language ID drops documents without any text in a learnt language and fills in missing languages; near-duplicate detection leaves one
document of each group of near copies; decontamination drops documents that hold a benchmark passage; the secret scan masks what it
finds; encoding adds token ids. Rows may repeat, any column may be null, texts may be empty or very long, tables may be empty
and may have further columns, also ones with names that an operator uses: each stage says what it makes of these.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import bpe, common, decontaminate, language, queries, secrets, simhash


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in like.columns))


#: Least share of a text's n-grams (of single letters, too) that the language model looks at: 0.97 and more for the texts of sf0.1, next
#: to none in a script that isn't learnt.
LEAST_KNOWN = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is `und` (null, or no letter), or whose text is in no language that the model has learnt (LEAST_KNOWN).
    The others stay, with the prediction for their language where it is null. Where no row has a language to learn from, only
    null and letterless texts go."""
    pred, score, known = common.fresh(docs, "_pred", "_score", "_known")
    model = language.learn(docs, F.lit(True))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language.predict(docs, model, pred=pred, score=score, known=known)
    kept = told.where((F.col(pred) != language.UNDETERMINED) & (F.col(known) >= LEAST_KNOWN))
    return _columns(kept.withColumn("lang", F.coalesce("lang", pred)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 and more, directly or by others, the one with the
    smallest doc_id stays: candidates are fingerprints of those shingles that BK-trees find near. Of repeated rows one stays, of
    rows without a doc_id all."""
    return _columns(simhash.keep_first(docs), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any word inside a benchmark window go (its spans are what the operator merges); items without an id count too. Of an
    empty benchmark nothing is hit."""
    benchmark = common.table(spark, sf_dir, "benchmark").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found = decontaminate.find_passages(docs, benchmark)
    return _columns(found.where(~F.col("contaminated")), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret of a text becomes `[SECRET]`, random strings that a fixed pattern covers in part as a whole, and
    n_chars follows the text."""
    base, spans = common.fresh(docs, "_base_spans", "_secret_spans")
    found = secrets.find_secrets(docs, base=base, spans=spans, partly=True)
    found = found.withColumn("text", secrets.masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        changed = (F.size(spans) > 0) & F.col("n_chars").isNotNull()
        found = found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _columns(found, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and digests of the ids and of the text decoded from them. A null text has no tokens; texts
    of any length are encoded whole; columns with the names of the new ones are replaced."""
    return bpe.encode_decode(docs, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN, ids="ids", digests=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]

#: Learnt models, fingerprints and merges aren't expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; an empty table gives an empty one of the last stage's columns."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(spark, stage(spark, docs, sf_dir), name)
    return docs
