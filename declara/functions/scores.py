"""Score transforms and combiners of the hierarchical label models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def log_sigmoid(v: Column) -> Column:
    return F.log(sigmoid(v))


def log_hinge(v: Column, p: int) -> Column:
    return -F.pow(F.greatest(1.0 - v, F.lit(0.0)), F.lit(float(p)))


def hinge(v: Column, p: int) -> Column:
    return F.exp(log_hinge(v, p))


def combine(parent: Column, child: Column, how: str) -> Column:
    if how == "add":
        return parent + child
    if how == "mul":
        return parent * child
    if how == "max":
        return F.greatest(parent, child)
    if how == "noisy_or":
        return 1.0 - (1.0 - parent) * (1.0 - child)
    raise ValueError(how)
