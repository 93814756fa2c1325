"""Expected details of findings: an expectation holds if its key-value pairs are among a finding's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(expected_id, n, first_id): for each row of `expected` (expected_id, details map) the number of findings (finding_id, details map) that have all its pairs, and the smallest of their ids.

    Expectations meet findings by the values of all their keys at once: for each set of keys that an expectation has, a finding with all these keys shows its values of them, findings that show the same
    are counted, and each expectation looks its own values up. So the work is findings times sets of keys, however many findings share a value; a null value is a value, a missing key is none. An
    expectation without pairs is held by every finding. Ids are distinct; null maps have no pairs.
    """
    given = lambda df: F.coalesce(df["details"], F.create_map().cast("map<string,string>"))
    wanted = expected.select("expected_id", given(expected).alias("details")).withColumn("keys", F.array_sort(F.map_keys("details")))
    values = F.transform("keys", lambda k: F.element_at("details", k))
    shapes = wanted.select("keys").distinct()
    shown = found.select("finding_id", given(found).alias("details")).join(F.broadcast(shapes), F.size(F.array_except("keys", F.map_keys("details"))) == 0)
    held = shown.groupBy("keys", values.alias("values")).agg(F.count("*").alias("n"), F.min("finding_id").alias("first_id"))
    return wanted.select("expected_id", "keys", values.alias("values")).join(held, ["keys", "values"], "left").select("expected_id", F.coalesce("n", F.lit(0)).alias("n"), "first_id")
