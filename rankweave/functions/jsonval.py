"""Strict JSON validity (a small Arrow-batched helper).

Spark's JSON readers stop at the end of the first value and ignore trailing
content, so '{"a": 1}}' would count as valid. Validity here follows the
JSON grammar (what the original's ``json.loads`` accepts), evaluated in
pandas batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


def _valid(s: pd.Series) -> pd.Series:
    def ok(x):
        if x is None:
            return False
        try:
            json.loads(x)
            return True
        except (ValueError, TypeError):
            return False
    return s.map(ok).astype(bool)


_json_valid = F.pandas_udf(_valid, T.BooleanType())


def json_is_valid(c: Column) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    return _json_valid(c)
