"""Decimal rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(value: Column, digits: int) -> Column:
    """Nearest decimal of the exact binary value, real ties to even.

    Spark's ``round`` works on the printed decimal, so 2.675 becomes 2.68 although
    the double lies below the tie. The product with 10^digits is split into its
    rounded part and its exact error (error-free product by halves), which decides
    the side of the tie. Needs a column or cheap expression: it is used repeatedly.
    """
    x, scale = value.cast("double"), float(10**digits)
    spread = x * 134217729.0
    high = spread - (spread - x)
    low = x - high
    product = x * scale
    error = (high * scale - product) + low * scale
    whole = F.floor(product)
    side = ((product - whole.cast("double")) - 0.5) + error
    up = (side > 0) | ((side == 0) & (whole % 2 != 0))
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / scale


def round_exact_sql(expression: str, digits: int) -> str:
    """The same rounding as SQL text, for oracle queries."""
    x, scale = f"(({expression})::double)", f"{10**digits}.0::double"
    high = f"({x} * 134217729.0::double - ({x} * 134217729.0::double - {x}))"
    product = f"({x} * {scale})"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    side = f"((({product} - floor({product})) - 0.5::double) + {error})"
    up = f"CASE WHEN {side} > 0 OR ({side} = 0 AND floor({product}) % 2 <> 0) THEN 1 ELSE 0 END"
    return f"((floor({product}) + {up}) / {scale})"
