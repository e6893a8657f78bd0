"""The corpus pipeline: documents pass five stages, each written as a table and read again by the next.

Rows are known by their id and a hash of their text, so rows that repeat an id stay apart. Every stage works on
all rows that its predecessor kept and, but for the last, returns the columns of documents.
"""

from pyspark.sql import functions as F

from captura.llm.common import materialize, repeated, table, without
from captura.llm.decontaminate import decontaminate
from captura.llm.jaccard_join import near_duplicates
from captura.llm.mixing import mix
from captura.llm.packed_ids import packed_corpus
from captura.llm.quality_rules import quality_verdicts


def quality(spark, docs, sf_dir):
    """Drop what the base rule or the outlier rule of its language and source rejects."""
    return without(docs, quality_verdicts(docs).filter("NOT kept"))


def one_of_each_group(spark, docs, sf_dir):
    """Keep of every group of near-duplicates the row with the smallest id; texts without words all stay."""
    groups = near_duplicates(docs)
    return repeated(docs, groups.select("doc_id", "text_hash", F.col("keep").cast("int").alias("copies")))


def clean_of_benchmark(spark, docs, sf_dir):
    """Drop documents that hold a window of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def mixture(spark, docs, sf_dir):
    """Take each document as often as the mixture of sources wants it."""
    return repeated(docs, mix(docs))


def token_files(spark, docs, sf_dir):
    """Write the ids of the mixture and report every document of the files."""
    return packed_corpus(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_files),
]

#: Robust covariances and hashed files are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
