"""Sums over tuples of distinct rows, from power sums instead of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SLOTS = 6


def partitions(items: tuple[int, ...]) -> Iterable[list[tuple[int, ...]]]:
    """All ways to split ``items`` into blocks."""
    if not items:
        yield []
        return
    head, rest = items[0], items[1:]
    for smaller in partitions(rest):
        yield [(head,), *smaller]
        for at, block in enumerate(smaller):
            yield [*smaller[:at], (head, *block), *smaller[at + 1 :]]


def subsets(n: int) -> list[tuple[int, ...]]:
    return [tuple(i for i in range(n) if mask >> i & 1) for mask in range(1, 1 << n)]


def weight(blocks: list[tuple[int, ...]]) -> int:
    """Moebius value of a partition: the product of (-1)^(b-1) (b-1)! over its block sizes b."""
    return reduce(lambda acc, b: acc * (-1) ** (len(b) - 1) * factorial(len(b) - 1), blocks, 1)


def distinct_sum(slots: tuple[int, ...], block_total: Callable[[tuple[int, ...]], Column]) -> Column:
    """Sum over tuples of distinct rows, given the column that totals each block's product."""
    if not slots:
        return F.lit(1)
    terms = []
    for blocks in partitions(slots):
        product = reduce(lambda a, b: a * b, (block_total(tuple(sorted(b))) for b in blocks))
        terms.append(product * F.lit(weight(blocks)))
    return reduce(lambda a, b: a + b, terms)
