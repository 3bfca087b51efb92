"""Points in intervals: both are placed in buckets of an axis, so a point meets only what lies near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.merge import unused_name


def meet(points: DataFrame, spans: DataFrame, keys: list[str], at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Rows of ``points`` and ``spans`` with equal keys where the span covers the point's bucket.

    ``at``, ``low`` and ``high`` are numbers of one axis and ``width`` is a bucket's size: a span is held once for
    each bucket it covers, so spans should not be many times as wide. A point lies in one bucket, so no pair meets
    twice. Both ends count; whether the point is inside is the caller's to check.
    """
    name = unused_name(spans, unused_name(points, "_bucket"))
    cells = F.sequence(F.floor(low / width), F.greatest(F.floor(low / width), F.floor(high / width)))
    held = spans.where(low.isNotNull() & high.isNotNull()).withColumn(name, F.explode(cells))
    return points.withColumn(name, F.floor(at / width)).join(held, [*keys, name]).drop(name)
