"""Clusters of taxa as sorted arrays of names, and as bit masks: algebra in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladeframe.functions.sequences import bits_and, bits_count, column


def cluster(names) -> Column:
    """JT23: canonical form: sorted, without repeats or nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(column(names))))


def disjoint(a, b) -> Column:
    return ~F.arrays_overlap(column(a), column(b))


def contains(a, b) -> Column:
    """Every name of b is in a."""
    return F.size(F.array_except(column(b), column(a))) == 0


def compatible(a, b) -> Column:
    """JT23: disjoint, or one holds the other."""
    return disjoint(a, b) | contains(a, b) | contains(b, a)


def merged(a, b) -> Column:
    return F.array_sort(F.array_union(column(a), column(b)))


def complement(a, taxa) -> Column:
    return F.array_sort(F.array_except(column(taxa), column(a)))


def complementary(a, b, taxa) -> Column:
    return disjoint(a, b) & (F.size(F.array_except(column(taxa), merged(a, b))) == 0)


def is_branch(inner, outer, clusters) -> Column:
    """JT24: outer holds inner, and what it has more is a single taxon or one of the listed clusters."""
    more = F.array_sort(F.array_except(column(outer), column(inner)))
    return contains(outer, inner) & ((F.size(more) == 1) | F.array_contains(column(clusters), more))


def same_split(left_a, right_a, left_b, right_b) -> Column:
    """JT25: equal bipartitions, whichever side is called left."""
    a, b, c, d = map(column, (left_a, right_a, left_b, right_b))
    return ((a == c) & (b == d)) | ((a == d) & (b == c))


def compatible_bits(a, b, width: Column | int) -> Column:
    """JT21: two splits as masks (arrays of words) over `width` taxa: one of the four intersections is empty."""
    n = F.lit(width) if isinstance(width, int) else width
    both, own_a, own_b = bits_count(bits_and(a, b)), bits_count(a), bits_count(b)
    return (both == 0) | (own_a == both) | (own_b == both) | (n - own_a - own_b + both == 0)
