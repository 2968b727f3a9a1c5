"""Text renderings of points, formatted as C's %.4f, which the JVM's format rounds differently."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def format_xyz(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series(["%.4f %.4f %.4f" % row for row in zip(x.astype(float), y.astype(float), z.astype(float), strict=True)])
