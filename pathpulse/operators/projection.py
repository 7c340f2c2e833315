"""Two-dimensional projection of standardised features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def principal_components(df: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Rows with ``pc1 … pck`` and the share of variance each explains; signs are arbitrary."""
    ready = df.withColumn("features", array_to_vector("vec"))
    model = Pipeline(
        stages=[
            StandardScaler(inputCol="features", outputCol="x", withMean=True),
            PCA(k=k, inputCol="x", outputCol="pc"),
        ]
    ).fit(ready)
    out = model.transform(ready).withColumn("_pc", vector_to_array("pc"))
    columns = {f"pc{i + 1}": F.get("_pc", i) for i in range(k)}
    shares = [float(v) for v in model.stages[-1].explainedVariance.toArray()]
    return out.withColumns(columns).drop("features", "x", "pc", "_pc"), shares


def class_name(label: str) -> Column:
    """0 → Healthy, 1 → Unhealthy."""
    return F.when(F.col(label) == 0, "Healthy").when(F.col(label) == 1, "Unhealthy")
