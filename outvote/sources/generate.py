"""Labelled sample data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: shape of the generated data
ANOMALY_SHIFT, ANOMALY_VARIANCE = 3.0, 2.0
CATEGORY_A, CATEGORY_B = ["Type1", "Type2", "Type3"], ["Group_X", "Group_Y"]


def sample_dataset(
    spark: SparkSession, n_samples: int = 1000, n_features: int = 10, contamination: float = 0.1, random_state: int = 1
) -> DataFrame:
    """Standard normal rows followed by anomalies around 3 with variance 2, a 0/1 label,
    two categories and an integer from 1 to 99. row_id numbers the rows."""
    n_normal = int(n_samples * (1 - contamination))
    anomaly = F.col("row_id") >= n_normal
    normals = [F.randn(random_state * 1000 + i) for i in range(n_features)]
    features = [
        F.when(anomaly, F.lit(ANOMALY_SHIFT) + F.lit(ANOMALY_VARIANCE**0.5) * z).otherwise(z).alias(f"feature_{i}")
        for i, z in enumerate(normals)
    ]

    def pick(values: list[str], seed: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))

    return spark.range(n_samples).withColumnRenamed("id", "row_id").select(
        "row_id",
        *features,
        anomaly.cast("double").alias("is_anomaly"),
        pick(CATEGORY_A, random_state * 1000 + 901).alias("category_A"),
        pick(CATEGORY_B, random_state * 1000 + 902).alias("category_B"),
        (F.floor(F.rand(random_state * 1000 + 903) * 99) + 1).cast("int").alias("integer_feature"),
    )
