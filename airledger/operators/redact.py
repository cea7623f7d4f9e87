"""The one place where personal data of licensees is withheld."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an individual's rows don't show, and what no row shows, while redaction is on.
INDIVIDUAL = ("licensee_name", "licensee_city", "address", "location_name")
ALWAYS = ("trustee_name",)


def redact(df: DataFrame, on: bool = True) -> DataFrame:
    """Hides personal columns that df has: of individuals (is_individual), and trustees' names of every licence.

    Adds licensee_redacted where licensee_name is shown. A null is_individual counts as an individual.
    """
    person = F.coalesce(F.col("is_individual"), F.lit(True)) if "is_individual" in df.columns else F.lit(True)
    if "licensee_name" in df.columns:
        df = df.withColumn("licensee_redacted", person if on else F.lit(False))
    if not on:
        return df
    hidden = {c: F.when(~person, F.col(c)) for c in INDIVIDUAL if c in df.columns} | {c: F.lit(None).cast("string") for c in ALWAYS if c in df.columns}
    return df.withColumns(hidden) if hidden else df
