"""Numbers and unit expressions: a small grammar, dimensions as exponent vectors.

unit    := factor (separator factor)*        separator: blank, ``·``, ``*``, ``.`` or ``/``
factor  := [degree word] [prefix] symbol [exponent]
A unit is (scale, offset, vector) with the vector over (amount, length,
temperature); a value v means v * scale + offset in mol, metres and kelvin. Only
a single temperature symbol may carry an offset.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

TEMPERATURE = (0, 0, 1)
CONCENTRATION = (1, -3, 0)
KIND = {"temperature": TEMPERATURE, "ionic_strength": CONCENTRATION}


class Unit(NamedTuple):
    scale: Fraction
    offset: Fraction
    dims: tuple[int, int, int]


_ZERO = Fraction(0)
#: symbol: scale, offset, (amount, length, temperature), takes prefixes, takes exponents
_SYMBOLS: dict[str, tuple[Fraction, Fraction, tuple[int, int, int], bool, bool]] = {
    "K": (Fraction(1), _ZERO, TEMPERATURE, False, False),
    "C": (Fraction(1), Fraction(27315, 100), TEMPERATURE, False, False),
    "F": (Fraction(5, 9), Fraction(45967, 100) * Fraction(5, 9), TEMPERATURE, False, False),
    "mol": (Fraction(1), _ZERO, (1, 0, 0), True, False),
    "M": (Fraction(1000), _ZERO, CONCENTRATION, True, False),
    "L": (Fraction(1, 1000), _ZERO, (0, 3, 0), True, True),
    "m": (Fraction(1), _ZERO, (0, 1, 0), True, True),
}
#: written form: symbol. Words are read in any case, single letters only as given.
_WORDS = {"kelvins": "K", "kelvin": "K", "celsius": "C", "centigrade": "C", "fahrenheit": "F", "moles": "mol", "mole": "mol", "mol": "mol", "molar": "M", "litres": "L", "litre": "L", "liters": "L", "liter": "L"}
_LETTERS = {"K": "K", "k": "K", "C": "C", "c": "C", "F": "F", "f": "F", "℃": "C", "℉": "F", "K": "K", "M": "M", "L": "L", "l": "L", "ℓ": "L", "m": "m"}
_PREFIX_WORDS = {"milli": Fraction(1, 1000), "micro": Fraction(1, 10**6), "nano": Fraction(1, 10**9)}
_PREFIX_LETTERS = {"m": Fraction(1, 1000), "u": Fraction(1, 10**6), "µ": Fraction(1, 10**6), "μ": Fraction(1, 10**6), "n": Fraction(1, 10**9), "d": Fraction(1, 10), "c": Fraction(1, 100)}

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_FACTOR = re.compile(
    r"(?:(?P<deg>(?i:degrees?|deg)\.?\s*|[°º˚]\s*))?"
    rf"(?:(?P<pw>(?i:{'|'.join(_PREFIX_WORDS)}))?(?P<word>(?i:{'|'.join(_WORDS)}))"
    rf"|(?P<pl>[{''.join(_PREFIX_LETTERS)}])?(?P<letter2>(?:mol|M|L|l|m))|(?P<letter>[{''.join(_LETTERS)}]))"
    r"(?P<exp>\s?\^\s?[-−+]?[1-3]|[-−][1-3]|[1-3]|[⁻⁺]?[¹²³])?(?![A-Za-zµμ\d])"
)
_SEPARATOR = re.compile(r"\s*[·*∙⋅/]\s*|\s+|\.(?=[a-zA-Z])")
_NUMBER = re.compile(r"(?<![\d,\w])(?<!\d\.)(?P<sign>[-−–+]\s?)?(?P<digits>\d+(?:[.,]\d+)?|[.]\d+)(?:[eE](?P<e>[-−+]?\d+)|\s*[x×·]\s*10\s?\^?\s?(?P<t>[-−+⁻]?[\d⁰¹²³⁴-⁹]+))?")
_OPEN = re.compile(r"\s*[)\]]?\s*[(\[]?\s*")


def _factor(m: re.Match) -> tuple[Unit, bool] | None:
    if m["word"]:
        name, prefix = _WORDS[m["word"].lower()], _PREFIX_WORDS.get((m["pw"] or "").lower())
    elif m["letter2"]:
        name, prefix = _LETTERS.get(m["letter2"], m["letter2"]), _PREFIX_LETTERS.get(m["pl"] or "")
    else:
        name, prefix = _LETTERS[m["letter"]], None
    scale, offset, dims, prefixed, powered = _SYMBOLS[name]
    if (prefix is not None and not prefixed) or (m["deg"] and dims != TEMPERATURE) or (m["exp"] and not powered):
        return None
    scale = scale * (prefix or 1)
    power = int(m["exp"].translate(_SUPER).replace("−", "-").replace("^", "").replace(" ", "")) if m["exp"] else 1
    return Unit(scale**power, offset, tuple(d * power for d in dims)), bool(offset)


def read_unit(text: str, at: int = 0) -> tuple[Unit, int] | None:
    """The longest unit expression at ``at`` and where it ends."""
    unit, end, sign, pos = None, at, 1, at
    while m := _FACTOR.match(text, pos):
        got = _factor(m)
        if got is None:
            break
        factor, shifted = got
        if unit is None:
            unit = factor
        elif shifted or unit.offset:
            break
        else:
            unit = Unit(unit.scale * factor.scale**sign, _ZERO, tuple(a + sign * b for a, b in zip(unit.dims, factor.dims, strict=True)))
        end = m.end()
        sep = _SEPARATOR.match(text, end)
        if not sep:
            break
        sign, pos = (-1 if "/" in sep[0] else 1), sep.end()
    return (unit, end) if unit else None


@lru_cache(maxsize=4096)
def whole_unit(text: str | None, dims: tuple[int, int, int]) -> Unit | None:
    """The unit that a text consists of, if it has these dimensions."""
    got = read_unit(text := (text or "").strip().strip("()[]").strip())
    return got[0] if got and got[1] == len(text) and got[0].dims == dims else None


class Quantity(NamedTuple):
    value: Fraction
    unit: Unit | None
    start: int
    end: int


def _value(m: re.Match) -> Fraction:
    whole, _, part = m["digits"].replace(",", ".").partition(".")
    value = Fraction(int(whole + part), 10 ** len(part))
    if power := m["e"] or m["t"]:
        value *= Fraction(10) ** max(-400, min(400, int(power.translate(_SUPER).replace("−", "-"))))
    return -value if m["sign"] and m["sign"].strip() in "-−–" else value


def quantities(text: str, dims: tuple[int, int, int]) -> list[Quantity]:
    """Each number with the unit after it, if that has the dimensions asked for; units' digits are no numbers."""
    out, pos = [], 0
    while m := _NUMBER.search(text, pos):
        start = m.start()
        got = read_unit(text, _OPEN.match(text, m.end()).end())
        known = got and got[0].dims == dims
        pos = got[1] if known else m.end()
        out.append(Quantity(_value(m), got[0] if known else None, start, pos))
    return out


def in_steps(value: Fraction, unit: Unit, quantity: str) -> int:
    """value * scale + offset: kelvin in hundredths, mol/m3 in µmol/L; halves away from zero. In whole numbers, exact."""
    scale, offset = unit.scale, unit.offset
    below = value.denominator * scale.denominator
    n = (value.numerator * scale.numerator * offset.denominator + offset.numerator * below) * (100 if quantity == "temperature" else 1000)
    d = below * offset.denominator
    return (2 * n + d) // (2 * d) if n >= 0 else -((d - 2 * n) // (2 * d))


_ERROR = re.compile(r"±|\+\s?/\s?[-−]|\+-")
_QUANTITY_WORDS = re.compile(r"(?i)\b(?:total|sample|ionic[\s_]+strength|temperature|temp\b\.?|in|of|the|unit[s]?|solution)\b\.?|[\[\](),:;]|_")


def quantity_of(var_type: str | None) -> str | None:
    """Ionic strength before temperature, as in the deposition rules."""
    low = re.sub(r"[\s_]+", " ", (var_type or "").lower())
    return "ionic_strength" if "ionic strength" in low else "temperature" if "temp" in low else None


@lru_cache(maxsize=4096)
def _type_unit(var_type: str | None, dims: tuple[int, int, int]) -> Unit | None:
    return whole_unit(" ".join(_QUANTITY_WORDS.sub(" ", var_type or "").split()), dims)


@lru_cache(maxsize=65536)
def read_condition(var_type: str | None, val: str | None, val_units: str | None) -> tuple[str, int] | None:
    """(quantity, value in steps) of a condition row; the error after ``±`` is ignored.

    A unit beside the number goes before the unit field, that before a unit in
    the type. Without number, known unit or known quantity there is no result.
    """
    quantity = quantity_of(var_type)
    if quantity is None or not val:
        return None
    dims = KIND[quantity]
    found = quantities(val, dims)
    if not found:
        return None
    unit = found[0].unit
    if unit is None and len(found) > 1 and _ERROR.search(val[found[0].end : found[1].start + 1]):
        unit = found[1].unit
    unit = unit or whole_unit(val_units, dims) or _type_unit(var_type, dims)
    return (quantity, in_steps(found[0].value, unit, quantity)) if unit else None


_LOWER = re.compile(r"(?i)(?:>|≥|>=|⩾|at least|from|above|over|min(?:imum)?\.?)\s*=?\s*$")
_UPPER = re.compile(r"(?i)(?:<|≤|<=|⩽|at most|up to|until|below|under|max(?:imum)?\.?)\s*=?\s*$")
_INF = re.compile(r"(?i)[-−+]?\s*(?:inf(?:inity)?\b|∞)")
YES = frozenset(("y", "yes", "true", "t", "1", "on"))


def is_yes(flag: str | None) -> bool:
    return (flag or "").strip().lower() in YES


def _bounds(text: str, dims: tuple[int, int, int]) -> tuple[Quantity | None, Quantity | None, bool]:
    """(lower, upper, is ``a ± b``) as written; None where open."""
    inner = text.strip()
    if inner.startswith("[") and "]" in inner:
        # the comma parts the bounds: the one followed by a blank, else the only one
        body, tail = inner[1 : inner.rindex("]")], inner[inner.rindex("]") + 1 :]
        cut = body.find(", ")
        cut = cut if cut >= 0 else body.find(",")
        if cut >= 0:
            sides = [quantities(part, dims) for part in (body[:cut], body[cut + 1 :])]
            lo, hi = (s[0] if s else None for s in sides)
            outer = read_unit(tail.strip())
            if outer and outer[0].dims == dims:
                lo, hi = (q and q._replace(unit=q.unit or outer[0]) for q in (lo, hi))
            return lo, hi, False
    found = quantities(inner, dims)
    if not found:
        return None, None, False
    if len(found) == 1:
        before, after = inner[: found[0].start], inner[found[0].end :]
        if _UPPER.search(before) or _INF.search(before):
            return None, found[0], False
        if _LOWER.search(before) or _INF.search(after):
            return found[0], None, False
        return found[0], found[0], False
    a, b = found[0], found[1]
    # a dash between the bounds is no sign of the second
    between = inner[a.end : b.start]
    if b.value < 0 and not re.search(r"\S", between) and inner[b.start] in "-−–":
        b = b._replace(value=-b.value)
    return a, b, bool(_ERROR.search(inner[a.end : b.start + 1]))


@lru_cache(maxsize=65536)
def read_range(text: str | None, unit: str | None, assume: str | None, correct: str | None, quantity: str) -> tuple[tuple[str, int], ...]:
    """((side, value in steps), ...) of the finite bounds with a known unit.

    A unit beside one bound, before a colon, or in the unit field holds for both.
    Without any, kelvin or mol/L is assumed if ``assume`` is yes; if ``correct``
    is yes too, a temperature from 15 to below 50 is in °C and an ionic strength
    above 5 in mM.
    """
    if not text:
        return ()
    dims = KIND[quantity]
    lead = re.match(r"\s*([^:]+):", text)
    leading = whole_unit(lead[1], dims) if lead else None
    lead = lead if leading else None
    lo, hi, spread = _bounds(text[lead.end() :] if lead else text, dims)
    if lo is None and hi is None:
        return ()
    stated = (lo and lo.unit) or (hi and hi.unit) or leading or whole_unit(unit, dims)
    own = [("lo", lo and lo.value, (lo and lo.unit) or (hi and hi.unit)), ("hi", hi and hi.value, (hi and hi.unit) or (lo and lo.unit))]
    if spread:
        both = (lo.unit or hi.unit, lo.value, abs(hi.value))
        own = [("lo", both[1] - both[2], both[0]), ("hi", both[1] + both[2], both[0])]
    out = []
    for side, value, given in own:
        if value is None:
            continue
        known = given or stated
        if known is None:
            if not is_yes(assume):
                continue
            name = "K" if quantity == "temperature" else "M"
            if is_yes(correct):
                if quantity == "temperature" and 15 <= value < 50:
                    name = "°C"
                elif quantity == "ionic_strength" and value > 5:
                    name = "mM"
            known = whole_unit(name, dims)
        out.append((side, in_steps(value, known, quantity)))
    return tuple(out)
