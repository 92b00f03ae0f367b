"""Linear spot classifier with a calibrated score, on Spark's own estimators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed clipping of the calibrated score.
LOGIT_CLIP, P_CLIP = 30.0, 1e-12


@dataclass
class LinearHead:
    assembler: VectorAssembler
    scaler: object
    model: object
    slope: float
    offset: float

    def logits(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(self.scaler.transform(self.assembler.transform(rows)))
        return scored.withColumn("logit", vector_to_array("rawPrediction")[1]).drop("x", "scaled", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame) -> DataFrame:
        """rows plus p_exist: the calibrated probability, clipped away from 0 and 1."""
        a = F.greatest(F.least(F.col("logit") * self.slope + self.offset, F.lit(LOGIT_CLIP)), F.lit(-LOGIT_CLIP))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-a))
        return self.logits(rows).withColumn("p_exist", F.greatest(F.least(p, F.lit(1 - P_CLIP)), F.lit(P_CLIP))).drop("logit")


def train(fit_rows: DataFrame, held_rows: DataFrame, features: list[str], label: str = "y", ridge: float = 1e-3) -> LinearHead:
    """Weights from the fitting groups, calibration slope and offset from the held-out ones."""
    assembler = VectorAssembler(inputCols=features, outputCol="x")
    fit_x = assembler.transform(fit_rows)
    scaler = StandardScaler(inputCol="x", outputCol="scaled", withMean=True, withStd=True).fit(fit_x)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=ridge, maxIter=50).fit(scaler.transform(fit_x))
    head = LinearHead(assembler, scaler, model, 1.0, 0.0)
    one = VectorAssembler(inputCols=["logit"], outputCol="z").transform(head.logits(held_rows))
    platt = LogisticRegression(featuresCol="z", labelCol=label, maxIter=50).fit(one)
    head.slope, head.offset = float(platt.coefficients[0]), float(platt.intercept)
    return head
