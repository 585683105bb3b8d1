"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
``run`` writes each stage's rows to the shared checkpoint folder and reads them again.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolebook.llm import bpe, decontaminate, langid, pii, simhash
from rolebook.llm import texts as X
from rolebook.llm.queries import public_ranks
from rolebook.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits that the best language needs for a byte of a text past which it may be in none; the share among
#: all languages from which the best one replaces a language that is given; what the excess of any text may be
#: beside what labelled rows show.
STRANGE, SURE, SLACK = 7.5, 0.9, 4.0


def excess() -> Column:
    """How far a text's code length lies above ``STRANGE`` bits a byte, by the spread that
    a mean of so many bytes has: one odd word exceeds it more than a page in that language."""
    return (F.col("bits_per_byte") - STRANGE) * F.sqrt(F.octet_length("text").cast("double"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones among them) go, and texts in no learned
    language: those whose ``excess`` is over ``SLACK`` and twice that of any labelled row that was not
    learned from, so the shorter a text, the more it may exceed. Without such rows none goes for it. lang becomes
    the predicted one, but where the best language is not ``SURE`` a given one stays.
    Rows are judged one by one by their text: repeated rows alike, ids and other columns of no
    account. No rows give none."""
    docs = docs.select(*COLUMNS)
    learned = X.crc_mod(F.col("doc_id"), 3) != 1
    model = langid.train(docs, learned)
    held_out = langid.label(docs.where(~learned & F.col("lang").isNotNull()), model).where("lang_pred <> 'und'")
    most = held_out.agg(F.max(excess()).alias("x")).first().x
    kept = langid.label(docs, model).where("lang_pred <> 'und'")
    if most is not None:
        kept = kept.where(excess() <= SLACK + 2 * max(most, 0.0))
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return kept.select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, rows without an id after
    all others, of two texts with that id the one of the least hash, of rows alike one. Null and
    empty texts are one group. No rows give none."""
    return simhash.one_each(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: a twentieth of their words, and one, inside windows of
    benchmark items. Null texts have no words and stay; rows alike stay or go together; without
    items all stay."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; n_chars follows the new text and is null
    with it. Every row stays, repeated ones too, each by its own text."""
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of what decoding them gives, a row for each
    row; a null text is encoded as an empty one."""
    return bpe.round_trip(docs, *public_ranks())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("encoding", encoding),
]
#: No SQL expresses the learned languages, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
