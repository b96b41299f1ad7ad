"""From raw documents to training tokens, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's documents.  All but the last return the columns
they got.  Extra columns of the input pass through, whatever their names.
Stages judge rows, not ids: a row without an id, or with one that others have
too, goes or stays by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrelate.llm import decontamination, exact_dedup, language_id, near_dedup, pieces
from matrelate.llm.common import delete, materialize, passing, scratch_path
from matrelate.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the corpus' languages go: those without letters and those that fit no language.

    The model and what a language's texts score at least come from all its
    labelled rows, none left out; the fewer n-grams a text has, the more it may fall short (``language_id.fits``).
    Null and empty texts go.  Null ids, repeated rows and null languages stay.
    A corpus without any labelled row has no languages to test against and
    stays whole; an empty one gives an empty result.
    """
    model = language_id.fit_all(docs)
    if not model.languages:
        return docs
    fits = language_id.fits(language_id.least_scores(docs, model))
    return language_id.identify(docs, model).where(fits).select("record.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; a null id loses against any other.

    Null counts as empty text.  Of rows equal in id and text one stays.
    """
    return exact_dedup.drop_duplicates(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) the one with the smallest id stays.

    Null and repeated ids are told apart by their texts, so one row of a group
    stays whatever its ids.  Texts without words are near to nothing and stay.
    """
    return near_dedup.drop_near_copies(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote ten words in a row of a benchmark item, or a whole shorter item, go.

    Null and empty texts quote nothing and stay; items without words are not
    quoted; equal texts are judged alike, whatever their ids.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, items, window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, one row per document; null and empty texts have none."""
    out = pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), carry=["doc_id"], as_array=True)
    return out.select("record.doc_id", "n_tokens", F.col("ids").alias("token_ids"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminate),
    ("tokens", tokens),
]

#: Language identification and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before have written is deleted on the way."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with passing(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path=path)
        if before:
            delete(spark, before)
        before = path
    return docs
