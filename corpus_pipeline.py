"""The corpus pipeline: each stage applies one operator's decisions to all that its predecessor kept."""
from __future__ import annotations

from loomline.llm import jaccard, mixing, packing, quality, toxicity
from loomline.llm.common import free, materialise, scratch_tables


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def keep_good(spark, docs, sf_dir):
    return quality.keep_good(docs)


def one_of_each(spark, docs, sf_dir):
    return jaccard.one_of_each(docs)


def mix(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def pack(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_good), ("n-gram jaccard join", one_of_each), ("mixing sources", mix), ("best-fit packing", pack)]

#: The trained model has no SQL form; the tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; every one but the last is written as Parquet and read again, and then the tables
    that the stage made for itself are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch_tables(spark):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"), keep=True)
        free(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
