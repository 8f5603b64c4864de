"""Units of the known columns, by rules on their names."""

from __future__ import annotations

import re
from functools import lru_cache

from .units import Unit

LENGTH = "code_length small_a / small_h"
MASS = "code_mass / small_h"
VELOCITY = "code_velocity small_a^(1/2)"
DENSITY = "code_density small_h2 / small_a3"
FIELD = "code_pressure^(1/2) small_a^-2 small_h"
PRESSURE = "code_pressure small_h2 small_a^-3"
RATE = "code_mass / code_time"
PURE = ""

#: First match counts. A rule holds for the species it names, or for all.
_RULES: list[tuple[str, str, str]] = [
    ("voronoi_cells|dark_matter|stars|black_holes|default", r"Coordinates|CenterOfMass|SubfindHsml|BH_Hsml|Softenings?", LENGTH),
    ("voronoi_cells|dark_matter|stars|black_holes|default", r"Masses|GFM_InitialMass|BH_CumMassGrowth_\w+|BH_HostHaloMass|BH_Mass\w*", MASS),
    ("voronoi_cells|dark_matter|stars|black_holes|default", r"Velocities", VELOCITY),
    ("*", r"ParticleIDs|AllowRefinement|ElectronAbundance|NeutralHydrogenAbundance|HighResGasMass_?Fraction|Machnumber|GFM_Metal\w*|GFM_StellarFormationTime|BH_Progs|\w*GrNr|\w*IDMostbound|\w*Parent|\w*Metal\w*|(?:Group|Subhalo)Len(?:Type)?|GroupFirstSub|GroupNsubs", PURE),
    ("*", r"Potential", "code_velocity^2 / small_a"),
    ("voronoi_cells", r"VelocityGradient", "code_velocity small_h / code_length small_a^-1"),
    ("voronoi_cells", r"BfieldGradient", "code_pressure^(1/2) small_a^-3 small_h2 / code_length"),
    ("voronoi_cells", r"Acceleration", "code_velocity^2 small_h / code_length small_a^-1"),
    ("voronoi_cells", r"MagneticField", FIELD),
    ("voronoi_cells", r"EnergyDissipation", "code_mass code_velocity^3 / code_length small_a"),
    ("voronoi_cells", r"InternalEnergy", "code_velocity^2"),
    ("voronoi_cells", r"StarFormationRate", "Msun / yr"),
    ("voronoi_cells", r"Pressure", PRESSURE),
    ("voronoi_cells", r"Volume", "code_length^3 small_a^3 small_h^-3"),
    ("voronoi_cells", r"SmoothedMagneticField", FIELD),
    ("*", r"Density|SubfindD?M?Density|SubfindDensity|BH_Density", DENSITY),
    ("*", r"SubfindVelDisp|SubhaloVel(?:Disp)?|SubhaloVmax", "code_velocity"),
    ("stars|subhalos", r"\w*StellarPhotometrics", "mag"),
    ("subhalos", r"SubhaloStellarPhotometricsMassInRad", MASS),
    ("black_holes", r"BH_(?:CumEgyInjection|MPB_CumEgy)_?\w+", "small_a2 small_h^-1 code_energy"),
    ("*", r"BH_Mdot\w*|\w+BHMdot", RATE),
    ("black_holes", r"BH_Pressure", "code_mass code_length^-1 code_time^-2"),
    ("black_holes", r"BH_U", "code_velocity^2"),
    ("groups", r"GroupVel", "code_velocity / small_a"),
    ("groups|subhalos", r"\w+SFR\w*", "Msun / yr"),
    ("subhalos", r"SubhaloBfld\w+", FIELD),
    ("subhalos", r"SubhaloSpin", "code_length code_velocity / small_h"),
    ("subhalos", r"SubhaloVmaxRad", VELOCITY),
    ("groups|subhalos", r"\w*Mass\w*|Group_M_\w+", MASS),
    ("groups|subhalos", r"\w+(?:Pos|CM)|Group_R_\w+|\w+Rad(?:Type)?", LENGTH),
]


@lru_cache(maxsize=None)
def builtin_unit(species: str, block: str) -> Unit | None:
    """The unit of a column, in default code units, or None."""
    for kinds, pattern, unit in _RULES:
        if (kinds == "*" or species in kinds.split("|")) and re.fullmatch(pattern, block):
            return Unit.parse(unit)
    return None


def unit_for(species: str, block: str, comoving: bool = True, h: float = 0.7) -> Unit | None:
    """As ``builtin_unit``, without powers of a in a non-comoving run and of h where h is one."""
    unit = builtin_unit(species, block)
    if unit is None and species not in ("voronoi_cells", "dark_matter", "groups", "subhalos"):
        unit = builtin_unit("dark_matter", block)
    if unit is None:
        return None
    gone = [*(("a",) if not comoving else ()), *(("h",) if h == 1 else ())]
    return unit.without(*gone) if gone else unit
