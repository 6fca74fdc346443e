"""Vector arithmetic over array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return _total(F.zip_with(_doubles(left), _doubles(right), lambda a, b: a * b))


def norm(vector: Column) -> Column:
    return F.sqrt(_total(F.transform(_doubles(vector), lambda a: a * a)))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of the angle; NULL when a vector has zero length."""
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def squared_distance(left: Column, right: Column) -> Column:
    return _total(
        F.zip_with(_doubles(left), _doubles(right), lambda a, b: (a - b) * (a - b))
    )
