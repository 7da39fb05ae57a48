"""Join keys of small tables that are broadcast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same(*pairs: tuple[Column, Column]) -> Column:
    """All of the pairs are equal, as a join condition whose only key is a hash of them in one long.

    A broadcast by other keys takes a memory page, up to 64 MB by the size of the heap, of the driver and of each executor,
    however few rows it holds; by one long it takes 1 MB and its rows. The values are compared too, with ``isin``, as an
    equality of columns would become a key beside the hash.
    """
    left, right = zip(*pairs)
    condition = F.xxhash64(*left) == F.xxhash64(*right)
    for one, other in pairs:
        condition = condition & one.isin(other)
    return condition
