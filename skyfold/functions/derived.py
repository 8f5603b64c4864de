"""Built-in derived columns of gas, and the resolver that finds out which of them a snapshot can give."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..units import BOLTZMANN, ELECTRON, PROTON
from . import vectors as v

HYDROGEN = 0.76
SPHERE = 4 * math.pi / 3


@dataclass(frozen=True)
class Derived:
    """A column by the keys it needs; ``unit`` is a product of unit texts or of keys in braces."""

    needs: tuple[str, ...]
    build: Callable
    unit: str | None = None


def _pressure(s) -> Column:
    if s.gamma == 1:
        raise ValueError("an isothermal gas has no pressure from its internal energy")
    return F.lit(s.gamma - 1) * s.col("0_InternalEnergy") * s.col("0_Density")


def _pressure_volume(s) -> Column:
    if s.gamma == 1:
        return s.col("0_Volume") * s.col("0_Pressure")
    return F.lit(s.gamma - 1) * s.col("0_Masses") * s.col("0_InternalEnergy")


def _molecular_weight(s) -> Column:
    x = s.col("0_GFM_Metals")[0] if s.stores("0_GFM_Metals") else F.lit(HYDROGEN)
    if s.stores("0_ElectronAbundance"):
        return F.lit(4.0) / (F.lit(1.0) + F.lit(3.0) * x + F.lit(4.0) * x * s.col("0_ElectronAbundance"))
    return F.lit(4.0) / (F.lit(5.0) * x + F.lit(3.0))


def _temperature(s) -> Column:
    if s.gamma == 1:
        raise ValueError("an isothermal gas has no temperature from its internal energy")
    # kelvin: mean molecular weight times hydrogen mass over Boltzmann's constant, energies in cgs
    factor = (s.gamma - 1) * (ELECTRON + PROTON) / BOLTZMANN * s.code.velocity**2
    return s.col("0_InternalEnergy") * s.col("0_MeanMolecularWeight") * F.lit(factor)


def _number_density(s) -> Column:
    unit = s.unit("0_Density")
    factor = unit.scale * s.h ** float(unit.power("h")) * s.a ** float(unit.power("a")) / PROTON
    return s.col("0_Density") * F.lit(factor) / s.col("0_MeanMolecularWeight")


def _half_curl_square(s) -> Column:
    c = v.curl(s.col("0_VelocityGradient"))
    return F.lit(0.5) * v.dot(c, c)


def _times(*keys: str) -> Callable:
    def build(s) -> Column:
        out = s.col(keys[0])
        for k in keys[1:]:
            out = out * s.col(k)
        return out

    return build


BUILTIN: dict[str, Derived] = {
    "0_Volume": Derived(("0_Masses", "0_Density"), lambda s: F.try_divide(s.col("0_Masses"), s.col("0_Density")), "{0_Masses} / {0_Density}"),
    "0_Diameters": Derived(("0_Volume",), lambda s: F.lit(2.0) * F.cbrt(s.col("0_Volume") / F.lit(SPHERE)), "{0_Volume}^(1/3)"),
    "0_VelocityMagnitude": Derived(("0_Velocities",), lambda s: F.sqrt(v.square(s.col("0_Velocities"))), "{0_Velocities}"),
    "0_VelocityCurvature": Derived(("0_Velocities", "0_VelocityGradient"), lambda s: v.curvature(s.col("0_Velocities"), s.col("0_VelocityGradient")), "1 / {0_Coordinates}"),
    "0_Enstrophy": Derived(("0_VelocityGradient",), _half_curl_square, "{0_VelocityGradient}^2"),
    "0_EnstrophyTimesMasses": Derived(("0_Enstrophy", "0_Masses"), _times("0_Enstrophy", "0_Masses"), "{0_Enstrophy} {0_Masses}"),
    "0_MagneticFieldSquared": Derived(("0_MagneticField",), lambda s: v.square(s.col("0_MagneticField")), "{0_MagneticField}^2"),
    "0_MagneticFieldStrength": Derived(("0_MagneticFieldSquared",), lambda s: F.sqrt(s.col("0_MagneticFieldSquared")), "{0_MagneticField}"),
    "0_MagneticFieldSquaredTimesVolume": Derived(("0_Volume", "0_MagneticFieldSquared"), _times("0_Volume", "0_MagneticFieldSquared"), "{0_Volume} {0_MagneticFieldSquared}"),
    "0_MagneticCurvature": Derived(("0_MagneticField", "0_BfieldGradient"), lambda s: v.curvature(s.col("0_MagneticField"), s.col("0_BfieldGradient")), "1 / {0_Coordinates}"),
    "0_Current": Derived(("0_BfieldGradient",), lambda s: F.sqrt(v.dot(v.curl(s.col("0_BfieldGradient")), v.curl(s.col("0_BfieldGradient")))), "{0_BfieldGradient}"),
    "0_Pressure": Derived(("0_InternalEnergy", "0_Density"), _pressure, "{0_InternalEnergy} {0_Density}"),
    "0_PressureTimesVolume": Derived(("0_Masses", "0_InternalEnergy"), _pressure_volume, "{0_Masses} {0_InternalEnergy}"),
    "0_MeanMolecularWeight": Derived((), _molecular_weight, ""),
    "0_Temperatures": Derived(("0_InternalEnergy", "0_MeanMolecularWeight"), _temperature, "K"),
    "0_TemperaturesTimesMasses": Derived(("0_Temperatures", "0_Masses"), _times("0_Temperatures", "0_Masses"), "{0_Temperatures} {0_Masses}"),
    "0_NumberDensity": Derived(("0_Density", "0_MeanMolecularWeight"), _number_density, "cm^-3"),
    "0_GFM_MetallicityTimesMasses": Derived(("0_GFM_Metallicity", "0_Masses"), _times("0_Masses", "0_GFM_Metallicity"), "{0_GFM_Metallicity} {0_Masses}"),
    "0_MachnumberTimesEnergyDissipation": Derived(("0_Machnumber", "0_EnergyDissipation"), _times("0_Machnumber", "0_EnergyDissipation"), "{0_Machnumber} {0_EnergyDissipation}"),
}


def feasible(stored: Iterable[str], functions: Mapping[str, Derived]) -> dict[str, Derived]:
    """The functions whose needs can all be met, at any depth; one that needs itself is left out."""
    have, left, out = set(stored), dict(functions), {}
    while True:
        ready = {k: d for k, d in left.items() if all(n in have or n in out for n in d.needs)}
        if not ready:
            return out
        out |= ready
        left = {k: d for k, d in left.items() if k not in ready}
