"""Grade grouping and small conditional helpers (K1-K8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x, lo: int = 1, hi: int = 5) -> Column:
    """K1: clamp to lo..hi; NULL stays NULL (greatest/least would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def group_threshold(x) -> Column:
    """K2: x<=2 -> 0, x<=4 -> 1, else 2.  NULL falls to the ELSE branch -> 2."""
    x = _c(x)
    return F.when(x <= 2, 0).when(x <= 4, 1).otherwise(2).cast("int")


def group_membership(x) -> Column:
    """K3: {1,2} -> 0, {3,4} -> 1, 5 -> 2, anything else unchanged (NULL stays)."""
    x = _c(x)
    return (F.when(x.isin(1, 2), F.lit(0)).when(x.isin(3, 4), F.lit(1))
            .when(x == 5, F.lit(2)).otherwise(x)).cast("int")


def binary_group(x) -> Column:
    """K4: x >= 1 -> 1 else 0 (NULL -> 0)."""
    return F.when(_c(x) >= 1, 1).otherwise(0).cast("int")


def merge_two_into_one(x) -> Column:
    """K5: 2 -> 1, everything else (NULL too) unchanged."""
    x = _c(x)
    return F.when(x == 2, F.lit(1)).otherwise(x).cast("int")


def correct(a, b) -> Column:
    """K8 / Q11: equality where a missing side counts as disagreement."""
    return F.coalesce(_c(a) == _c(b), F.lit(False)).cast("int")
