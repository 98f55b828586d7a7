"""Vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import fit_index, nearest_vectors
from ..sources import load

#: Neighbours of each asked vector, and the share of the lists that it looks into. The given embeddings spread almost evenly, so
#: for a recall of 0.9 (by a test at all sizes) most lists are needed; with 0.4 of them it is 0.8.
NEIGHBOURS, PROBED = 10, 0.65


def nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings, by cosine, of every one whose id is divisible by 50, from an index of all."""
    embeddings = load(spark, sf_dir, "embeddings")
    index = fit_index(embeddings, "vec_id", "embedding")
    probes = max(1, round(PROBED * len(index.centres)))
    found = nearest_vectors(index, embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", NEIGHBOURS, probes)
    return found.select("query", F.col("id").alias("near"), "rank", F.round("cosine", 6).alias("cosine"))


QUERIES = {"nearest_embeddings": nearest_embeddings}

SQL: dict[str, str] = {}
