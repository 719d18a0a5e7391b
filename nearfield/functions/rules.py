"""Parameter rules and size estimates as column arithmetic."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield import settings
from nearfield.functions.vectors import _col


class ProbeRule(NamedTuple):
    """Lists per probe, and the bounds on the probes over floats and over codes."""

    share: int
    floats: tuple[int, int]
    codes: tuple[int, int]


# Fixed values of the recommendation.
ROWS_PER_LIST = 200
LISTS_BOUNDS = (50, 500)
SMALL_K_MAX = 200
SMALL_K = ProbeRule(16, (8, 40), (24, 120))
LARGE_K = ProbeRule(12, (10, 50), (30, 200))
CODE_PROBE_FACTOR = 3


def _within(c: Column, bounds: tuple[int, int]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), c)).cast("int")


def ivf_params(num_vectors: Column | str, k: Column | str) -> tuple[Column, Column, Column]:
    """Recommended (lists, probes, probes over codes); rounding is half-even."""
    lists = _within(F.floor(_col(num_vectors) / ROWS_PER_LIST), LISTS_BOUNDS)

    def probes(rule: ProbeRule) -> Column:
        return _within(F.bround(lists / rule.share), rule.floats)

    def by_k(of_rule) -> Column:
        return F.when(_col(k) <= SMALL_K_MAX, of_rule(SMALL_K)).otherwise(of_rule(LARGE_K))

    over_codes = by_k(lambda rule: _within(probes(rule) * CODE_PROBE_FACTOR, rule.codes))
    return lists, by_k(probes), over_codes


def search_width(need: Column | str) -> Column:
    """Beam width of a graph search that must return ``need`` rows."""
    return F.least(
        F.greatest(F.lit(settings.GRAPH_SEARCH_WIDTH), _col(need)),
        F.lit(settings.GRAPH_SEARCH_WIDTH_MAX),
    ).cast("int")


def vector_storage_mb(num_vectors: Column | str, dims: Column | str, precision: Column) -> Column:
    """Estimated MB of a float column, one tenth of overhead included."""
    width = F.when(precision == "float32", 4).otherwise(2)
    return _col(num_vectors) * _col(dims) * width * F.lit(1.1) / F.lit(1048576.0)


def code_storage_mb(num_vectors: Column | str, dims: Column | str, bits: Column | str) -> Column:
    """Estimated MB of a code column, one tenth of overhead included."""
    return _col(num_vectors) * _col(dims) * _col(bits) / F.lit(8.0) * F.lit(1.1) / F.lit(1048576.0)
