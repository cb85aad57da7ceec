"""Filter presets and options of a dataset build."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

INF = math.inf
SCORE_TYPES = ("zscores", "pscores")
FORMATS = ("csv", "json")

# fixed values: terms of the presets
_DENATURANTS = ("guanidin", "GdmCl", "Gdn-Hcl", "urea")
_MORE_CHEMICALS = ("BME", "2-ME", "mercaptoethanol", "TFA", "trifluoroethanol", "Potassium Pyrophosphate", "acetic acid", "CD3COOH", "DTT", "dithiothreitol", "dss", "deuterated sodium acetate")


@dataclass(frozen=True)
class Filters:
    """One preset; ranges are inclusive, infinite bounds are open."""

    temperature_range: tuple[float, float] = (263.0, 333.0)
    ionic_strength_range: tuple[float, float] = (0.0, 7.0)
    ph_range: tuple[float, float] = (2.0, 12.0)
    unit_assumptions: bool = True
    unit_corrections: bool = True
    default_conditions: bool = True
    peptide_length_range: tuple[float, float] = (5, INF)
    min_backbone_shift_types: int = 2
    min_backbone_shift_positions: int = 3
    min_backbone_shift_fraction: float = 0.0
    max_noncanonical_fraction: float = 0.1
    max_x_fraction: float = 0.2
    keywords_blacklist: tuple[str, ...] = ("denatur",)
    chemical_denaturants: tuple[str, ...] = _DENATURANTS
    exp_method_whitelist: tuple[str, ...] = ("", "solution", "structures")
    exp_method_blacklist: tuple[str, ...] = ("solid", "state")
    max_offset: float = 3.0
    reject_shift_type_only: bool = True


TOLERANT = Filters()
PRESETS = {
    "unfiltered": Filters(
        temperature_range=(-INF, INF), ionic_strength_range=(0.0, INF), ph_range=(-INF, INF), min_backbone_shift_types=1, max_noncanonical_fraction=1.0, max_x_fraction=1.0,
        keywords_blacklist=(), chemical_denaturants=(), exp_method_whitelist=("", "."), exp_method_blacklist=(), max_offset=INF,
    ),
    "tolerant": TOLERANT,
    "moderate": replace(
        TOLERANT, temperature_range=(273.0, 323.0), ionic_strength_range=(0.0, 5.0), ph_range=(4.0, 10.0), unit_corrections=False, peptide_length_range=(10, INF), min_backbone_shift_types=3,
        min_backbone_shift_positions=8, min_backbone_shift_fraction=0.6, max_noncanonical_fraction=0.025, max_x_fraction=0.05, keywords_blacklist=("denatur", "unfold", "misfold"), reject_shift_type_only=False,
    ),
    "strict": Filters(
        temperature_range=(273.0, 313.0), ionic_strength_range=(0.0, 3.0), ph_range=(6.0, 8.0), unit_assumptions=False, unit_corrections=False, default_conditions=False, peptide_length_range=(15, INF),
        min_backbone_shift_types=5, min_backbone_shift_positions=12, min_backbone_shift_fraction=0.8, max_noncanonical_fraction=0.0, max_x_fraction=0.0,
        keywords_blacklist=("denatur", "unfold", "misfold", "interacti", "bound"), chemical_denaturants=_DENATURANTS + _MORE_CHEMICALS, exp_method_whitelist=("solution", "structures"), max_offset=2.0, reject_shift_type_only=False,
    ),
}


def filters(preset: str = "tolerant", **explicit) -> Filters:
    """A preset with explicitly given options, which win."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}: one of {', '.join(PRESETS)}")
    known = {f.name for f in fields(Filters)}
    if unknown := set(explicit) - known:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return replace(PRESETS[preset], **{k: v for k, v in explicit.items() if v is not None})
