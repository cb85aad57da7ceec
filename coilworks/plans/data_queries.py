"""Registered queries of the general data operators (problems 1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coilworks.operators import nested, units
from coilworks.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.node_rows(table(spark, sf_dir, "raw_records"))


def _flat(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.flat_tables(table(spark, sf_dir, "raw_records"))[name]

    return query


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.standard_values(table(spark, sf_dir, "sample_conditions"), table(spark, sf_dir, "filter_defaults"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found} | {f"p1_{name}": _flat(name) for name in ("assemblies", "components", "entities", "links")}
SQL: dict[str, str] = {}
