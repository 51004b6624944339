"""Weather clusters and their two-dimensional projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cluster(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], k: int = 3, seed: int = 0) -> tuple[DataFrame, PipelineModel]:
    """K-means on the numbers and the levels of the categories, and the first two principal components (centred).

    Levels are places of sparse vectors, every level one, so a row costs its numbers and one entry per category however many
    levels there are; a null is a level of its own. The projection needs the covariance of all places, so their number is
    bounded by its square fitting into the driver (some thousands). Rows with a null number are left out.
    """
    known = df.na.drop("any", subset=list(numeric))
    index, hot = [f"_i_{c}" for c in categories], [f"_h_{c}" for c in categories]
    coding = [
        StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False),
    ] if categories else []
    model = Pipeline(stages=[
        *coding, VectorAssembler(inputCols=[*numeric, *hot], outputCol="_v"),
        KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster"), PCA(k=2, inputCol="_v", outputCol="_pc"),
    ]).fit(known)
    # MLlib projects without centring; the mean's own projection is taken off, which is one row.
    out = model.transform(known).withColumn("_pc", vector_to_array("_pc"))
    middle = out.agg(F.array(F.avg(F.col("_pc")[0]), F.avg(F.col("_pc")[1])).alias("m")).scalar()
    axes = {f"pc{i + 1}": F.col("_pc")[i] - middle[i] for i in (0, 1)}
    return out.withColumns(axes).select(*[F.col(f"`{c}`") for c in df.columns], "cluster", "pc1", "pc2"), model


def profile(df: DataFrame, numeric: Sequence[str], key: str = "cluster") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in numeric])


def label_clusters(profiles: DataFrame) -> DataFrame:
    """Name clusters by their centre, as ids are arbitrary: the warmest, the windiest of the rest, the rest.

    ``profiles`` has one row per cluster."""
    every = W.partitionBy(F.lit(0))
    warm = F.row_number().over(every.orderBy(F.desc("temperature"))) == 1
    ranked = profiles.withColumn("_warm", warm)
    windy = F.row_number().over(W.partitionBy("_warm").orderBy(F.desc("wind_speed"))) == 1
    named = F.when(F.col("_warm"), "hot-dry").when(windy, "windy").otherwise("cool-humid")
    return ranked.withColumn("cluster_label", named).drop("_warm")
