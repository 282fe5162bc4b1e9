"""Names of monitored model terms such as ``E.alpha.cm`` or ``n[2]``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_parameter(term: Column) -> Column:
    """Parameter name without index and population prefix."""
    return F.regexp_replace(F.regexp_replace(term, r"\[[0-9]+\]", ""), r"^E\.", "")


def is_population(term: Column) -> Column:
    return term.startswith("E.")


def is_treatment_level(term: Column) -> Column:
    return term.rlike(r"^(alpha\.cm|n|theta\.r)\[[0-9]+\]$")


def term_index(term: Column) -> Column:
    digits = F.regexp_extract(term, r"\[([0-9]+)\]", 1)
    return F.when(digits != "", digits).cast("int")


def term_group(term: Column, levels: Sequence[str]) -> Column:
    """Level the index stands for; NULL for population terms."""
    return F.try_element_at(F.array(*[F.lit(x) for x in levels]), term_index(term))
