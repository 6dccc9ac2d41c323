"""Attack probability per feature row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.schemas import DEFAULT_THRESHOLD, FEATURES

# --- fixed values: probabilities of the four leaves of the example rule -------
RULE_MANY_SYN_MANY_PKTS = 0.95
RULE_MANY_SYN_FEW_PKTS = 0.60
RULE_LONG_FLOW = 0.15
RULE_SHORT_FLOW = 0.01
# ---------------------------------------------------------------------------


def rule_score(ratio: float = 10.0, packets: float = 1000.0, duration: float = 60.0) -> Column:
    """A two-level example rule; usable as a scorer where no model is trained."""
    return (
        F.when(
            F.col("syn_ack_ratio") > ratio,
            F.when(F.col("pkt_count") > packets, RULE_MANY_SYN_MANY_PKTS).otherwise(RULE_MANY_SYN_FEW_PKTS),
        )
        .when(F.col("flow_duration") > duration, RULE_LONG_FLOW)
        .otherwise(RULE_SHORT_FLOW)
    )


def score(features: DataFrame, model: PipelineModel | Column | Callable[..., Column]) -> DataFrame:
    """Add ``score``: from a fitted pipeline, an expression, or a vectorised UDF.

    A UDF gets the feature columns packed as one float array and runs on Arrow
    batches inside the executors.
    """
    if isinstance(model, Column):
        return features.withColumn("score", model.cast("double"))
    if isinstance(model, PipelineModel):
        scored = model.transform(features)
        # A model that ends in SQL brings its score.
        found = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in scored.columns else F.col("score")
        return scored.select(*features.columns, found.alias("score"))
    packed = F.array(*[F.col(c).cast("float") for c in FEATURES])
    return features.withColumn("score", model(packed).cast("double"))


def onnx_scorer(model_path: str, batch_size: int = 4096) -> Callable[..., Column]:
    """Scorer for an exported model file that every executor can open.

    The session is made once per Python worker. The last output that has a
    probability per class is read; a single-column output is used as it is.
    """

    def load():
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        input_name = session.get_inputs()[0].name

        def predict(batch):
            outputs = session.run(None, {input_name: np.asarray(batch, dtype=np.float32)})
            probability = np.asarray(outputs[-1], dtype=np.float64)
            return probability.reshape(len(batch), -1)[:, -1]

        return predict

    return predict_batch_udf(
        load, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[len(FEATURES)]]
    )


def threshold(scored: DataFrame, t: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Strictly above the threshold is an attack."""
    return scored.withColumn("is_attack", F.coalesce(F.col("score") > F.lit(float(t)), F.lit(False)))
