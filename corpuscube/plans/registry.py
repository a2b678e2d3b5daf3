"""Every registered query of the library and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscube.plans import cube, forms, ir, lex, lid, store, summ

FLAGSHIP = "ir_search_or"
FAMILIES = (ir, lid, cube, summ, lex, forms, store)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for family in FAMILIES for q in family.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
