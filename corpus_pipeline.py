"""From raw documents to token files: toxicity, near duplicates, contamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it to the shared folder and the next stage
reads it from there, so a lost executor costs at most the stage at work. Other columns of ``documents`` than doc_id,
text and source are carried along untouched, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardframe.llm import decontaminate, mixing, ordermin, storage, tokenfile, toxicity

MAX_TOXICITY = 0.7
TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = 50_257

# The SQL check cannot state learned scores, alignments or a tokenizer; stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below MAX_TOXICITY, by a model of the labelled documents outside the held-out third. NULL texts score as
    empty ones and stay."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels)
    name, taken = "_toxicity", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return toxicity.score_toxicity(docs, model, name=name).where(F.col(name) < MAX_TOXICITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    return ordermin.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Documents that share an id, also a NULL one, are judged each by its own
    text: they are known by a hash of id and text. The row travels as a struct, so that no name of its columns can clash.
    NULL and empty texts stay; an empty table gives an empty table."""
    tag = F.xxhash64(F.col("doc_id").cast("long"), "text")
    found = decontaminate.contaminated(docs.select(tag.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), tag.alias("tag"))
    return carried.join(found.select(F.col("doc_id").alias("tag")).distinct(), "tag", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight: a row for each copy of a document that the mix takes, the text of a source's last,
    partial copy cut at the budget."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.md5("text").alias("digest"))
    mixed = mixing.mix(sized, "size", tie=["digest"])
    return mixing.emit(mixed, "size", "row").select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row in the packed format, and from the files: doc_id, start, n_tokens and the ids' checksum."""
    path = storage.shared_folder(spark, "pipeline-ids")
    tokenfile.write_texts(docs, path, public_tokenizers.path(TOKENIZER), VOCABULARY)
    return tokenfile.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _bounded(function):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.bound_batches(spark)
        return function(spark, docs, sf_dir)

    stage.__name__, stage.__doc__ = function.__name__, function.__doc__
    return stage


STAGES = [
    ("toxicity", _bounded(drop_toxic)),
    ("near duplicates", _bounded(drop_near_copies)),
    ("decontamination", _bounded(drop_contaminated)),
    ("mixing", _bounded(mix_sources)),
    ("token ids", _bounded(write_token_ids)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs, path = storage.write_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            storage.delete_table(spark, before)
        before = path
    return docs
