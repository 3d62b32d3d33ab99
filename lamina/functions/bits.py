"""Keys that tell apart what Spark's grouping takes as equal: doubles by their bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def double_bits(s: pd.Series) -> pd.Series:
    """The 64 bits of a double: 0.0 and -0.0 differ, a NaN is itself."""
    return pd.Series(s.to_numpy("float64").view("int64"), index=s.index)
