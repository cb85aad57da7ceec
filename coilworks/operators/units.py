"""Quantities recorded in different units, brought to kelvin and mol/L (problem 5).

The text grammar of :mod:`coilworks.functions.units` runs in Arrow
UDFs behind the column-pruned scan; there is no shuffle and no state, and
distinct spellings are read once for each worker. ``std_value`` counts
hundredths of a kelvin or µmol/L.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coilworks.functions import units

_LIMIT = 2**63

# types as objects: workers import this module, where there is no session to parse them
_VALUE = T.StructType().add("quantity", T.StringType()).add("std_value", T.LongType())
_BOUNDS = T.ArrayType(T.StructType().add("quantity", T.StringType()).add("bound_side", T.StringType()).add("std_value", T.LongType()))
_VALUE_ARROW = pa.struct([("quantity", pa.string()), ("std_value", pa.int64())])
_BOUNDS_ARROW = pa.list_(pa.struct([("quantity", pa.string()), ("bound_side", pa.string()), ("std_value", pa.int64())]))


def _fits(value: int) -> bool:
    return -_LIMIT <= value < _LIMIT


@F.arrow_udf(_VALUE)
def _condition(var_type: pa.Array, val: pa.Array, val_units: pa.Array) -> pa.Array:
    read = (units.read_condition(*row) for row in zip(var_type.to_pylist(), val.to_pylist(), val_units.to_pylist()))
    return pa.array([{"quantity": r[0], "std_value": r[1]} if r and _fits(r[1]) else {"quantity": None, "std_value": None} for r in read], _VALUE_ARROW)


@F.arrow_udf(_BOUNDS)
def _ranges(t: pa.Array, tu: pa.Array, i: pa.Array, iu: pa.Array, assume: pa.Array, correct: pa.Array) -> pa.Array:
    out = []
    for a, b, c, d, e, f in zip(*[column.to_pylist() for column in (t, tu, i, iu, assume, correct)]):
        both = [("temperature", s, v) for s, v in units.read_range(a, b, e, f, "temperature")] + [("ionic_strength", s, v) for s, v in units.read_range(c, d, e, f, "ionic_strength")]
        out.append([{"quantity": q, "bound_side": s, "std_value": v} for q, s, v in both if _fits(v)])
    return pa.array(out, _BOUNDS_ARROW)


def condition_values(conditions: DataFrame) -> DataFrame:
    """cond_row, quantity, std_value of each condition with a number and a unit.

    Words instead of numbers, other quantities, unknown or missing units and
    nulls give no row; repeated rows give one row each; values beyond a bigint
    give none.
    """
    wanted = F.lower("var_type").rlike("temp|ionic")
    read = conditions.filter(wanted & F.col("val").isNotNull()).select("cond_row", _condition("var_type", "val", "val_units").alias("r"))
    return read.select("cond_row", "r.quantity", "r.std_value").filter(F.col("quantity").isNotNull())


def range_values(presets: DataFrame) -> DataFrame:
    """preset_row, quantity, bound_side, std_value of each finite bound with a known unit."""
    read = presets.select("preset_row", _ranges("temperature_range", "temperature_unit", "ionic_strength_range", "ionic_strength_unit", "unit_assumptions", "unit_corrections").alias("r"))
    return read.select("preset_row", F.inline("r"))


def standard_values(conditions: DataFrame, presets: DataFrame) -> DataFrame:
    """src_table, row_id, quantity, bound_side, std_value over both tables."""
    a = condition_values(conditions).select(F.lit("sample_conditions").alias("src_table"), F.col("cond_row").alias("row_id"), "quantity", F.lit("val").alias("bound_side"), "std_value")
    b = range_values(presets).select(F.lit("filter_defaults").alias("src_table"), F.col("preset_row").alias("row_id"), "quantity", "bound_side", "std_value")
    return a.unionByName(b)
