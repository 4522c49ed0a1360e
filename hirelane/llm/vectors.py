"""What operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, not all zero, every component there and finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(values, dims: int) -> np.ndarray:
    """Double-precision rows of an Arrow list array or a pandas column of lists."""
    if hasattr(values, "flatten"):
        return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.array(list(values), np.float64).reshape(-1, dims)
