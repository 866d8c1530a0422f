"""Sample catalogue of sources; a deployment loads its own with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.schemas import SOURCES

REGIONS = ("italy", "germany", "france", "spain", "united_kingdom", "world")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue kept as JSON lines."""
    return spark.read.schema(SOURCES).json(path)


def union(*lists: DataFrame) -> DataFrame:
    """The lists of regions one after another; a source that stands in two stands there twice."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def build(catalogue: DataFrame, multi_region: bool = False, home: str = REGIONS[0]) -> DataFrame:
    """The sources of a build: those of its home region, or of all regions."""
    return catalogue if multi_region else catalogue.where(F.col("region") == home)


def regions(spark: SparkSession) -> DataFrame:
    """region, ordinal."""
    return spark.createDataFrame([(r, k) for k, r in enumerate(REGIONS)], "region string, ordinal int")


def sample(spark: SparkSession, many: int = 20) -> DataFrame:
    """src0, src1, ...: one main outlet in four, regions in turn; for tests and for the tables that name such sources."""
    rows = [(f"src{k}", f"Outlet {k:02d}", REGIONS[k % len(REGIONS)], f"https://feeds.example/src{k}.xml", k % 4 == 0, ("it", "de", "fr", "es", "en", "en")[k % 6], [], None) for k in range(many)]
    return spark.createDataFrame(rows, SOURCES)
