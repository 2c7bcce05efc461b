"""Reproducible noise: a function of the row key, not of partitioning or task order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 12
_SPAN = float(16 ** _HEX_DIGITS)


def keyed_normal(parts: Sequence[Column], label: str) -> Column:
    """Standard normal deviate by Box-Muller from one digest of key and label.

    A task that is run again after an executor loss draws the same values.
    """
    digest = F.md5(F.concat_ws("|", *[part.cast("string") for part in parts], F.lit(label)))
    first = _uniform(F.substring(digest, 1, _HEX_DIGITS))
    second = _uniform(F.substring(digest, 1 + _HEX_DIGITS, _HEX_DIGITS))
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2.0) * F.pi() * second)


def _uniform(hex_digits: Column) -> Column:
    """Open interval (0, 1), so the logarithm is finite."""
    number = F.conv(hex_digits, 16, 10).cast("bigint")
    return (number + F.lit(0.5)) / F.lit(_SPAN)
