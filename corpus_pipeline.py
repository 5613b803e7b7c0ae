"""A training corpus from raw documents: toxic ones go, one of each group of near duplicates stays, benchmark
passages are cut, sources are mixed to target weights, and what is left is put into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.llm import decontaminate, mixing, ngram_join, slots, weak_toxicity
from merchlake.llm.batches import prepare, table
from merchlake.llm.components import saved
from merchlake.session import run_folder


def _row_column(docs: DataFrame) -> str:
    """A column name that the documents do not have, for a key that tells rows apart; ids may repeat or be null."""
    taken = {c.lower() for c in docs.columns}
    name = "__row"
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with their place in their file as a key, the same at every reading. Other tables are written first."""
    row = _row_column(docs)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = saved(docs, "rows")
    place = docs.metadataColumn("_metadata")
    key = F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("number"))
    return docs.withColumn(row, key), row


def _kept(keyed: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """Rows other than the rejected ones. These grow with the input: joined, not broadcast."""
    found = f"{row}_rejected"
    rejected = rejected.select(F.col("row").alias(found)).hint("merge")
    return keyed.join(rejected, keyed[row] == F.col(found), "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that are scored toxic. Null and empty texts stay, repeated rows are judged alike, whole texts of
    any length are read, and an empty table stays empty."""
    prepare(spark)
    keyed, row = _keyed(docs)
    scored = weak_toxicity.score_toxicity(keyed, table(spark, sf_dir, "labels"), row_col=row)
    return _kept(keyed, row, scored.filter("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group linked by five-word shingles at a similarity of 0.8.

    Only texts decide what is linked: other texts under the same id, or under none, stay. Null ids come last.
    """
    prepare(spark)
    keyed, row = _keyed(docs)
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row"))
    found = ngram_join.ngram_join(keyed.select(own.alias("own"), "text"), id_col="own", n=5, num=80, den=100)
    return _kept(keyed, row, found.filter("id <> component_id").select("id.row"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages; a document that is mostly benchmark goes. Null and empty texts stay as they are."""
    prepare(spark)
    cleaned = decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cleaned.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources more often; repeated rows are drawn one by one, a null source is a
    source, and null or empty texts are drawn as often as their source takes passes."""
    return mixing.drawn_documents(mixing.mix_sources(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every drawn document with its shard and its place there; ``record`` holds all its columns."""
    placed = slots.shard_records(docs, run_folder(spark, "slot-map"), carry=True)
    return slots.shard_digest(placed).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

# Several stages are beyond SQL: a fitted classifier, components, automata.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
