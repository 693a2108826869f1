"""Distances over unrolled integer columns, as expressions.

For pairs of many vectors use ``operators.kernels``: expressions over more columns
than code generation takes are interpreted.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def cols(dim: int, prefix: str = "q", of: str = "") -> list[str]:
    return [f"{of}.{prefix}{i}" if of else f"{prefix}{i}" for i in range(dim)]


def squared_distance(a: str, b: str, dim: int) -> Column:
    """Exact squared L2 of quantized vectors ``a.q*`` and ``b.q*`` as bigint."""

    def term(i: int) -> Column:
        d = F.col(f"{a}.q{i}") - F.col(f"{b}.q{i}")
        return (d * d).cast("bigint")

    return reduce(add, (term(i) for i in range(dim)))


def box_bound(q: str, box: str, dim: int) -> Column:
    """Squared L2 from ``q.q*`` to the box ``box.mn*``..``box.mx*``: a lower bound
    of the distance to anything inside."""

    def term(i: int) -> Column:
        v = F.col(f"{q}.q{i}")
        # an empty cluster has an inverted box, whose bound needs 64 bits
        d = F.greatest(v - F.col(f"{box}.mx{i}"), F.col(f"{box}.mn{i}") - v, F.lit(0)).cast("bigint")
        return d * d

    return reduce(add, (term(i) for i in range(dim)))
