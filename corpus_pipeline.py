"""From documents to packed sequences: language, toxicity, near duplicates, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder and hands the
reread table to the next stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.llm.common import free_name, smaller_batches, stored
from cohortframe.llm.language_id import UNKNOWN, held_out, identify, train_language_model
from cohortframe.llm.minhash_dedup import BROADCAST_ROWS, near_duplicates, with_set_key
from cohortframe.llm.packing import pack
from cohortframe.llm.toxicity import score_toxicity, train_toxicity_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language stay; those without text or letters (`und`) go.

    Every text with a letter is given the likeliest learned language, so the
    kernel model decides which one, not whether a text stays.

    Cases: null, empty and letterless texts go, and so does every row if no
    row has both letters and a language; repeated rows and rows of one doc_id,
    or of none, are judged each by their text; an empty table gives none; all
    columns of docs come back as they were, whatever their names."""
    smaller_batches(spark)
    model = train_language_model(docs.filter(~held_out(4, 2)))
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    return identify(docs, model, names).filter(F.col(names[0]) != UNKNOWN).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay.

    Cases: null and empty texts have the score of an empty window; without
    labels of both classes all stay; repeated rows and rows of one doc_id, or of
    none, are judged each by their text; an empty table gives none; all columns
    of docs come back as they were, whatever their names."""
    model = train_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "toxicity")
    return score_toxicity(docs, model, name).filter(F.col(name) < 0.5).select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays, in one row.

    Cases: rows of one doc_id are documents of each of their sets of shingles,
    so one may stay and another go; of several rows of a group's first doc_id
    the first by all columns stays; rows without words, or with null doc_id, link with nothing
    and stay; an empty table gives none; all columns of docs come back as they were."""
    groups = stored(near_duplicates(docs, keyed=True), "groups")
    repeated = stored(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    gone = stored(groups.filter("not kept").join(_small(repeated), "doc_id", "left_anti").select("doc_id"), "gone")
    if repeated.isEmpty():
        return docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)
    # rows whose doc_id occurs once go by doc_id; the others by their set as well, and one row of a component stays
    single = docs.join(_small(gone.unionByName(repeated)), "doc_id", "left_anti")
    several = with_set_key(docs.join(_small(repeated), "doc_id", "left_semi"))
    (key, size), component = several.columns[-2:], free_name(several, "component")
    staying = groups.filter("kept and n_shingles > 0").join(_small(repeated), "doc_id", "left_semi").select("doc_id", F.col("key").alias(key), F.col("component").alias(component)).distinct()
    worded = several.filter(F.col(size) > 0).join(staying, ["doc_id", key])
    least = worded.groupBy(component).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.select(*docs.columns).unionByName(several.filter(F.col(size) == 0).select(*docs.columns)).unionByName(least)


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens.

    Cases: null and empty texts are a piece of the end id; repeated rows and
    rows of one doc_id, or of none, are packed each; an empty table gives none;
    other columns of docs are ignored."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_groups),
    ("packing", packing),
]

#: The stages score by trained models and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
