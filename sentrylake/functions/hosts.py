"""Hosts as people read them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def readable(host: str) -> str:
    """Labels in Punycode as the characters they stand for; a host that is no such name stays as it is."""
    try:
        return host.encode("ascii").decode("idna")
    except UnicodeError:
        return host


def _all(host: pd.Series) -> pd.Series:
    return host.map(readable)


def register(spark: SparkSession) -> None:
    """Makes `readable_host` known to the session's SQL. It is meant for distinct hosts in Punycode, a few."""
    from ..shipping import ship

    ship(spark)
    spark.udf.register("readable_host", F.pandas_udf(_all, "string"))  # type: ignore[call-overload]
