"""Search indexes over the driver's tables, built once a session for as long as the files they come from are the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import inverted
from siltstone.plans.cache import stamp
from siltstone.plans.tables import corpus
from siltstone.session import removed, shared_folder

_known: dict[tuple, tuple[tuple, inverted.Index]] = {}


def held(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], vectors: bool = True) -> inverted.Index:
    """The index called name of the corpus that make gives, which is derived from the files below source; made again, and the
    old one deleted, if those have changed."""
    key, now = (spark.sparkContext.applicationId, name, source), stamp(spark, source)
    if key not in _known or _known[key][0] != now:
        if key in _known:
            removed(spark, _known.pop(key)[1].path)
        _known[key] = (now, inverted.build(make(), shared_folder(spark), vectors=vectors))
    return _known[key][1]


def documents(spark: SparkSession, sf_dir: str) -> inverted.Index:
    """Of documents as chunks."""
    return held(spark, "documents", f"{sf_dir}/documents.parquet", lambda: corpus(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> inverted.Index:
    """Of documents' words alone: the whole index if the session has it, else one without vectors."""
    source = f"{sf_dir}/documents.parquet"
    if (spark.sparkContext.applicationId, "documents", source) in _known:
        return documents(spark, sf_dir)
    return held(spark, "documents' words", source, lambda: corpus(spark, sf_dir), False)
