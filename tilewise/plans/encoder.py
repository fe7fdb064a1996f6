"""The boundary to a model: a batch function from input vectors to hidden states. No model is shipped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hidden_states(df: DataFrame, encoder: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, vec: str = "vec", width: int | None = None, batch_size: int = 256) -> DataFrame:
    """df with ``vec`` run through an encoder, batch by batch in Arrow; without one, df as it is.

    encoder makes the batch function, once a worker; it maps (rows, width) to (rows, any) float32.
    """
    if encoder is None:
        return df
    if width is None:
        raise ValueError("an encoder needs the width of its input")
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    run = predict_batch_udf(encoder, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.withColumn(vec, run(F.col(vec)))
