"""Small helpers for column expressions."""

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: lambdas would otherwise compute it again for every element."""
    return F.transform(F.array(value), use)[0]
