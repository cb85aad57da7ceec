import pytest
from hypothesis import given
from hypothesis import strategies as st

from coilworks.functions.units import TEMPERATURE, quantities, read_condition, read_range, whole_unit
from coilworks.operators import units


def rng(text, quantity="temperature", unit=None, assume="yes", correct="no"):
    return read_range(text, unit, assume, correct, quantity)


@pytest.mark.parametrize(
    "text,want",
    [
        ("[277,62 kelvin, 44.9 °C]", (("lo", 27762), ("hi", 31805))), ("[266,331.6]", (("lo", 26600), ("hi", 33160))), ("-1.8..7 C", (("lo", 27135), ("hi", 28015))),
        ("-5.8°C–30°C", (("lo", 26735), ("hi", 30315))), ("(25±9) °C", (("lo", 28915), ("hi", 30715))), ("> 10 C", (("lo", 28315),)), ("up to 7 ℃", (("hi", 28015),)),
        ("[-inf, 30 C]", (("hi", 30315),)), ("[274 k, +inf]", (("lo", 27400),)), ("deg C: 9 to 19", (("lo", 28215), ("hi", 29215))), ("any", ()), ("", ()), (None, ()),
        ("77 F – 86 F", (("lo", 29815), ("hi", 30315))), ("270-300 K", (("lo", 27000), ("hi", 30000))),
    ],
)
def test_temperature_ranges(text, want):
    assert rng(text) == want


def test_units_and_flags():
    assert rng("mmol L-1: 10 to 250", "ionic_strength") == (("lo", 10000), ("hi", 250000))
    assert rng("2e4 µmol/l … 5000 millimolar", "ionic_strength") == (("lo", 20000), ("hi", 5000000))
    assert rng("5..500", "ionic_strength", "mol m^-3") == (("lo", 5000), ("hi", 500000))
    assert rng("3..6", "ionic_strength", None, "yes", "yes") == (("lo", 3000000), ("hi", 6000))
    assert rng("15..50", "temperature", None, "T", "1") == (("lo", 28815), ("hi", 5000))
    assert rng("15..50", "temperature", None, None, "yes") == ()
    assert rng("15..50", "temperature", "K", "no", "yes") == (("lo", 1500), ("hi", 5000))


def test_conditions():
    assert read_condition("temperature (K)", "298", ".") == ("temperature", 29800)
    assert read_condition("temp", "25,5 ± 1", "deg C") == ("temperature", 29865)
    assert read_condition("ionic_strength", "ca. 19 mol m^-3", "n/a") == ("ionic_strength", 19000)
    assert read_condition("ionic strength", "0.1", "") is None
    assert read_condition("temperature", "room temperature", "K") is None
    assert read_condition("pH", "7", None) is None and read_condition(None, "7", "K") is None
    assert read_condition("temperature", "set to 77 F on the console", None) == ("temperature", 29815)


def test_dimensions():
    assert whole_unit("mol m-3", (1, -3, 0)).scale == 1 and whole_unit("mmol/L", (1, -3, 0)).scale == 1
    assert whole_unit("mol", (1, -3, 0)) is None and whole_unit("mM", TEMPERATURE) is None and whole_unit("m/s", (1, -3, 0)) is None


@given(st.text(max_size=60))
def test_any_text_is_read_without_error(text):
    quantities(text, TEMPERATURE)
    rng(text)
    rng(text, "ionic_strength", text)
    read_condition("temperature " + text, text, text)


@given(st.decimals(min_value=-200, max_value=900, places=2))
def test_celsius_round_trip(x):
    assert read_condition("temperature", f"{x} °C", None) == ("temperature", round(x * 100) + 27315)


def test_tables(spark):
    c = spark.createDataFrame([(1, "temp", "20", "C", "z"), (1, "temp", "20", "C", "z"), (2, None, None, None, None), (3, "temp", "x" * 5000, "K", "")], "cond_row bigint, var_type string, val string, val_units string, quantity string")
    f = spark.createDataFrame([(5, "[1,2] C", None, None, None, "no", None), (6, None, None, "1e400 M", None, "yes", "yes")], "preset_row bigint, temperature_range string, temperature_unit string, ionic_strength_range string, ionic_strength_unit string, unit_assumptions string, unit_corrections string")
    got = sorted(map(tuple, units.standard_values(c, f).collect()))
    assert got == [("filter_defaults", 5, "temperature", "hi", 27515), ("filter_defaults", 5, "temperature", "lo", 27415)] + [("sample_conditions", 1, "temperature", "val", 29315)] * 2
    assert units.standard_values(c.limit(0), f.limit(0)).count() == 0
