"""A catalogue of images: what a collection request selects, as conditions that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {
    "equals": lambda c, v: c == v,
    "notEquals": lambda c, v: c != v,
    "lessThan": lambda c, v: c < v,
    "greaterThan": lambda c, v: c > v,
    "lessThanOrEquals": lambda c, v: c <= v,
    "greaterThanOrEquals": lambda c, v: c >= v,
    "inList": lambda c, v: c.isin(v),
}


def condition(tree: dict) -> Column:
    """A condition from a tree: {"equals": [property, value]}, and, or (lists of trees), not (a tree), date ([property, from, to]), bounds ([x0, y0, x1, y1])."""
    (name, value), = tree.items()
    if name in ("and", "or"):
        return reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), map(condition, value))
    if name == "not":
        return ~condition(value)
    if name == "date":
        return F.col(value[0]).between(F.lit(value[1]).cast("timestamp"), F.lit(value[2]).cast("timestamp"))
    if name == "bounds":
        x0, y0, x1, y1 = value
        return (F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)
    if name not in COMPARISONS:
        raise ValueError(f"unknown filter: {name}")
    return COMPARISONS[name](F.col(value[0]), F.lit(value[1]) if not isinstance(value[1], list) else value[1])


def filtered(catalogue: DataFrame, tree: dict) -> DataFrame:
    return catalogue.where(condition(tree))


def collection(images: DataFrame, products: DataFrame, product: str | None = None, sensor: str | None = None, start: str | None = None, end: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Images (image, product_key, time, x0, y0, x1, y1) of a product and sensor, in a span of time, that meet a box; with their products' columns."""
    tests = [{"equals": [k, v]} for k, v in (("product", product), ("sensor", sensor)) if v is not None]
    own = [{"date": ["time", start or "0001-01-01", end or "9999-12-31"]}] * bool(start or end) + [{"bounds": list(box)}] * bool(box)
    chosen = filtered(products, {"and": tests}) if tests else products
    return (filtered(images, {"and": own}) if own else images).join(chosen, "product_key")
