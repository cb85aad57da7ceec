"""Sample conditions as the dataset build reads them: column expressions only.

These rules reproduce the published build, its Fahrenheit formula included
(``fix_fahrenheit`` corrects it). Exact unit conversion is in
:mod:`coilworks.operators.units`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A plain decimal number, else null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).cast("double"))


def variable(var_type: Column) -> Column:
    """ionic_strength, ph, pressure or temperature, tested in this order; else null."""
    low = F.lower(var_type)
    return F.when(low.contains("ionic strength"), "ionic_strength").when(low == "ph", "ph").when(low == "pressure", "pressure").when(low.contains("temp"), "temperature")


def last_values(conditions: DataFrame) -> DataFrame:
    """One row a condition list (entry_id, cond_list_id) with value and unit of each variable; the last row of a variable wins."""
    rows = conditions.select("entry_id", "cond_list_id", variable(F.col("var_type")).alias("v"), F.struct("cond_row", F.coalesce("val", F.lit("")).alias("val"), F.coalesce("val_units", F.lit("")).alias("unit")).alias("s"))
    last = [F.max(F.when(F.col("v") == name, F.col("s"))).alias(f"_{name}") for name in ("ionic_strength", "ph", "temperature")]
    out = rows.groupBy("entry_id", "cond_list_id").agg(*last)
    return out.select("entry_id", "cond_list_id", *[F.col(f"_{n}.{f}").alias(f"{n}_{f}") for n in ("ionic_strength", "ph", "temperature") for f in ("val", "unit")])


def ph(val: Column, default_conditions: bool = True) -> Column:
    return F.coalesce(number(val), F.lit(7.0)) if default_conditions else number(val)


def temperature(val: Column, unit: Column, assumptions: bool = True, corrections: bool = True, default_conditions: bool = True, fix_fahrenheit: bool = False) -> Column:
    """Kelvin. A unit with C or F is converted; K, or any other unit if assumed, is taken as is.

    Corrections apply to the latter: 15 to below 50 is read as °C, 50 to 100 as °F.
    """
    v, u = number(val), F.coalesce(unit, F.lit(""))
    fahrenheit = (v - 32) / 1.8 + 273.15 if fix_fahrenheit else (v - 32) * 1.8 + 273.15
    plain = F.when((v >= 15) & (v < 50), v + 273.15).when((v >= 50) & (v <= 100), fahrenheit).otherwise(v) if corrections else v
    known = F.when(u.contains("C"), v + 273.15).when(u.contains("F"), fahrenheit).when((u == "K") | F.lit(assumptions), plain)
    return F.when(v.isNull(), F.lit(298.0 if default_conditions else None).cast("double")).otherwise(known)


def ionic_strength(val: Column, unit: Column, assumptions: bool = True, corrections: bool = True, default_conditions: bool = True) -> Column:
    """mol/L. mM and mu (micromolar) are scaled; M, or any other unit if assumed, is taken as is, above 5 as mM with corrections."""
    v, u = number(val), F.coalesce(unit, F.lit(""))
    molar = F.when(v > 5, v * 0.001).otherwise(v) if corrections else v
    known = F.when(u == "mM", v * 0.001).when(u == "mu", v * 0.000001).when((u == "M") | F.lit(assumptions), molar)
    return F.when(v.isNull(), F.lit(0.1 if default_conditions else None).cast("double")).otherwise(known)
