"""A small unit algebra with cosmological scale factors.

A unit is a number times powers of base units; ``a`` (scale factor) and ``h`` (Hubble parameter) are base units too. A quantity is a value with a unit at some a and
h; its value may be a number, an array or a Spark Column, since conversion is one multiplication by a number known on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import numpy as np

PHYSICAL = ("cm", "g", "s", "K", "mag")
COSMIC = ("a", "h")
KPC = 3.0856775814913674e21
MSUN = 1.988409870698051e33
YEAR = 31557600.0
BOLTZMANN = 1.380649e-16
PROTON = 1.67262192369e-24
ELECTRON = 9.1093837015e-28
EV = 1.602176634e-12

_NAMED: dict[str, tuple[float, dict[str, Any]]] = {
    "cm": (1.0, {"cm": 1}),
    "m": (1e2, {"cm": 1}),
    "km": (1e5, {"cm": 1}),
    "pc": (KPC / 1e3, {"cm": 1}),
    "kpc": (KPC, {"cm": 1}),
    "Mpc": (KPC * 1e3, {"cm": 1}),
    "au": (1.495978707e13, {"cm": 1}),
    "g": (1.0, {"g": 1}),
    "kg": (1e3, {"g": 1}),
    "Msun": (MSUN, {"g": 1}),
    "s": (1.0, {"s": 1}),
    "yr": (YEAR, {"s": 1}),
    "Myr": (YEAR * 1e6, {"s": 1}),
    "Gyr": (YEAR * 1e9, {"s": 1}),
    "K": (1.0, {"K": 1}),
    "eV": (EV / BOLTZMANN, {"K": 1}),
    "keV": (1e3 * EV / BOLTZMANN, {"K": 1}),
    "erg": (1.0, {"g": 1, "cm": 2, "s": -2}),
    "J": (1e7, {"g": 1, "cm": 2, "s": -2}),
    "Pa": (10.0, {"g": 1, "cm": -1, "s": -2}),
    "G": (1.0, {"g": Fraction(1, 2), "cm": Fraction(-1, 2), "s": -1}),
    "uG": (1e-6, {"g": Fraction(1, 2), "cm": Fraction(-1, 2), "s": -1}),
    "T": (1e4, {"g": Fraction(1, 2), "cm": Fraction(-1, 2), "s": -1}),
    "mag": (1.0, {"mag": 1}),
    "small_a": (1.0, {"a": 1}),
    "small_h": (1.0, {"h": 1}),
}
_TOKEN = re.compile(r"\s*(/|\*\*|\^|\*|\(|\)|[A-Za-z_]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")


@dataclass(frozen=True)
class CodeUnits:
    """Length, mass and velocity units of a simulation, in cgs."""

    length: float = KPC
    mass: float = 1.989e43
    velocity: float = 1e5

    def named(self) -> dict[str, tuple[float, dict[str, Any]]]:
        t, e = self.length / self.velocity, self.mass * self.velocity**2
        return {
            "code_length": (self.length, {"cm": 1}),
            "code_mass": (self.mass, {"g": 1}),
            "code_velocity": (self.velocity, {"cm": 1, "s": -1}),
            "code_time": (t, {"s": 1}),
            "code_energy": (e, {"g": 1, "cm": 2, "s": -2}),
            "code_pressure": (e / self.length**3, {"g": 1, "cm": -1, "s": -2}),
            "code_density": (self.mass / self.length**3, {"g": 1, "cm": -3}),
        }


class Unit:
    """``scale`` (to cgs) times powers of base units. ``text`` is how it was written."""

    def __init__(self, scale: float = 1.0, powers: dict[str, Any] | None = None, text: str | None = None):
        self.scale = scale
        self.powers = {k: Fraction(v).limit_denominator(64) for k, v in (powers or {}).items() if v}
        self.text = text

    @staticmethod
    def parse(text: str, code: CodeUnits | None = None) -> Unit:
        """Products, quotients and powers of named units: ``code_mass small_h^-1 / kpc3``, ``code_velocity small_a^(1/2)``."""
        names = _NAMED | (code or CodeUnits()).named()
        tokens = _TOKEN.findall(text)
        if "".join(tokens) != re.sub(r"\s+", "", text):
            raise ValueError(f"can't read the unit {text!r}")
        out, sign, i = Unit(), 1, 0
        while i < len(tokens):
            tok = tokens[i]
            i += 1
            if tok == "/":
                sign = -1
                continue
            if tok == "*":
                continue
            if re.fullmatch(r"-?\d.*", tok):
                one = Unit(float(tok))
            elif tok in names:
                one = Unit(*names[tok])
            else:
                raise ValueError(f"unknown unit {tok!r} in {text!r}")
            power = Fraction(1)
            if i < len(tokens) and (tokens[i] in ("^", "**") or re.fullmatch(r"-?\d+", tokens[i]) and tok in names):
                i += tokens[i] in ("^", "**")
                if tokens[i] == "(":
                    end = tokens.index(")", i)
                    power = Fraction("".join(tokens[i + 1 : end]))
                    i = end + 1
                else:
                    power = Fraction(tokens[i])
                    i += 1
            out = out * one ** (power * sign)
            sign = 1
        return Unit(out.scale, out.powers, text.strip())

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.scale * other.scale, {k: self.powers.get(k, 0) + other.powers.get(k, 0) for k in self.powers | other.powers})

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def __pow__(self, n: Any) -> Unit:
        return Unit(self.scale ** float(n), {k: v * Fraction(n) for k, v in self.powers.items()})

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Unit) and self.powers == other.powers and bool(np.isclose(self.scale, other.scale, rtol=1e-12, atol=0))

    def __hash__(self) -> int:
        return hash(tuple(sorted(self.powers.items())))

    def power(self, name: str) -> Fraction:
        return self.powers.get(name, Fraction(0))

    def physical(self) -> Unit:
        """Without the powers of a and h."""
        return Unit(self.scale, {k: v for k, v in self.powers.items() if k not in COSMIC})

    def cosmic(self) -> Unit:
        """The powers of a and h alone."""
        return Unit(1.0, {k: v for k, v in self.powers.items() if k in COSMIC})

    def without(self, *names: str) -> Unit:
        return Unit(self.scale, {k: v for k, v in self.powers.items() if k not in names})

    def factor_to(self, other: Unit) -> float:
        """What a value is multiplied with to be in ``other``; both must have the same powers."""
        if self.powers != other.powers:
            raise ValueError(f"{self} and {other} are of different kinds")
        return self.scale / other.scale

    def __str__(self) -> str:
        if self.text is not None:
            return self.text
        parts = [] if self.scale == 1 else [f"{self.scale:.6g}"]
        for k in sorted(self.powers, key=lambda k: (k in COSMIC, k)):
            p, name = self.powers[k], {"a": "small_a", "h": "small_h"}.get(k, k)
            parts.append(name if p == 1 else f"{name}^{p}" if p.denominator == 1 else f"{name}^({p})")
        return " ".join(parts)

    __repr__ = __str__


CGS = {"cm": Unit.parse("cm"), "g": Unit.parse("g"), "s": Unit.parse("s")}


def scaled(value: Any, factor: float) -> Any:
    """``value * factor``; a Column gets a literal, and a factor of one leaves it alone."""
    if factor == 1.0:
        return value
    return value * factor


class Quantity:
    """A value with a unit, at scale factor ``a`` and Hubble parameter ``h``."""

    def __init__(self, value: Any, unit: str | Unit = "", a: float = 1.0, h: float = 1.0, comoving: bool = True, code: CodeUnits | None = None):
        self.code = code or CodeUnits()
        self.value, self.a, self.h, self.comoving = value, a, h, comoving
        self.unit = Unit.parse(unit, self.code) if isinstance(unit, str) else unit

    def _new(self, value: Any, unit: Unit, a: float | None = None) -> Quantity:
        return Quantity(value, unit, self.a if a is None else a, self.h, self.comoving, self.code)

    @property
    def z(self) -> float:
        """Redshift."""
        return 1 / self.a - 1

    @property
    def no_small_h(self) -> Quantity:
        """With h multiplied in."""
        return self._new(scaled(self.value, self.h ** float(self.unit.power("h"))), self.unit.without("h"))

    @property
    def to_physical(self) -> Quantity:
        """With a and h multiplied in."""
        factor = self.h ** float(self.unit.power("h")) * self.a ** float(self.unit.power("a"))
        return self._new(scaled(self.value, factor), self.unit.without(*COSMIC))

    def to_comoving(self, unit: str | Unit) -> Quantity:
        """In ``unit``, which may differ in its powers of a and h only."""
        new = Unit.parse(unit, self.code) if isinstance(unit, str) else unit
        if new.physical().powers != self.unit.physical().powers:
            raise ValueError(f"only powers of a and h may change between {self.unit} and {new}")
        factor = self.unit.scale / new.scale
        for name, at in (("a", self.a), ("h", self.h)):
            factor *= at ** float(self.unit.power(name) - new.power(name))
        return self._new(scaled(self.value, factor), new)

    def to(self, unit: str | Unit) -> Quantity:
        """In ``unit``; its powers of a and h are this quantity's own or left out."""
        new = Unit.parse(unit, self.code) if isinstance(unit, str) else unit
        if not new.cosmic().powers:
            new = Unit(new.scale, new.powers | self.unit.cosmic().powers)
        return self._new(scaled(self.value, self.unit.factor_to(new)), new)

    def to_any(self, unit: str | Unit) -> Quantity:
        """Units and powers of a and h at once."""
        return self.to_comoving(unit)

    def decompose(self, *bases: str) -> Quantity:
        """In the given base units (one each for length, mass, time), cgs where none is given."""
        new = Unit(1.0, self.unit.powers)
        for name in bases:
            base = Unit.parse(name, self.code)
            (kind,) = base.powers
            new = Unit(new.scale * base.scale ** float(self.unit.power(kind)), new.powers)
        return self._new(scaled(self.value, self.unit.scale / new.scale), new)

    @property
    def cgs(self) -> Quantity:
        return self.decompose()

    @property
    def si(self) -> Quantity:
        return self.decompose("m", "kg")

    @property
    def astro(self) -> Quantity:
        """kpc, solar masses and years."""
        return self.decompose("kpc", "Msun", "yr")

    @property
    def in_code(self) -> Quantity:
        """Code length, mass and time."""
        return self.decompose("code_length", "code_mass", "code_time")

    def adjust_time(self, a: float | None = None, z: float | None = None) -> Quantity:
        """At another time, physical value unchanged."""
        a = a if a is not None else 1 / (1 + z)
        return self._new(scaled(self.value, (self.a / a) ** float(self.unit.power("a"))), self.unit, a)

    def set_time(self, a: float | None = None, z: float | None = None) -> Quantity:
        """At another time, comoving value unchanged."""
        return self._new(self.value, self.unit, a if a is not None else 1 / (1 + z))

    def label(self, symbol: str) -> str:
        """Axis text: the symbol, then the unit with a and h set apart."""
        unit, cosmic = self.unit.physical(), self.unit.cosmic()
        names = [str(self.unit.text)] if self.unit.text is not None and not cosmic.powers else [str(x) for x in (unit, cosmic) if x.powers or x.scale != 1]
        text = " ".join(names).replace("small_a", "a").replace("small_h", "h")
        text = re.sub(r"\^\(?(-?\d+(?:/\d+)?)\)?", r"^{\1}", text)
        return f"${symbol}\\; \\left[{text}\\right]$" if text else f"${symbol}$"

    def _same(self, other: Quantity) -> None:
        if self.comoving != other.comoving or self.a != other.a or self.h != other.h:
            raise ValueError("the operands are at different a or h")

    def __add__(self, other: Quantity) -> Quantity:
        self._same(other)
        return self._new(self.value + scaled(other.value, other.unit.factor_to(self.unit)), self.unit)

    def __sub__(self, other: Quantity) -> Quantity:
        self._same(other)
        return self._new(self.value - scaled(other.value, other.unit.factor_to(self.unit)), self.unit)

    def __mul__(self, other: Any) -> Quantity:
        if not isinstance(other, Quantity):
            return self._new(self.value * other, self.unit)
        self._same(other)
        return self._new(self.value * other.value, self.unit * other.unit)

    __rmul__ = __mul__

    def __truediv__(self, other: Any) -> Quantity:
        if not isinstance(other, Quantity):
            return self._new(self.value / other, self.unit)
        self._same(other)
        return self._new(self.value / other.value, self.unit / other.unit)

    def __pow__(self, n: Any) -> Quantity:
        return self._new(self.value ** float(n), self.unit ** Fraction(n).limit_denominator(64))

    def __repr__(self) -> str:
        return f"{self.value} {self.unit}"


def stacked(quantities: list[Quantity]) -> Quantity:
    """One array of quantities whose units, a and h agree."""
    first = quantities[0]
    for q in quantities[1:]:
        first._same(q)
        if q.unit != first.unit:
            raise ValueError("units differ")
    return first._new(np.array([q.value for q in quantities]), first.unit)


def split_units(unit: Unit) -> tuple[dict[str, Fraction], dict[str, Fraction]]:
    """Physical and cosmological powers of a unit."""
    return unit.physical().powers, unit.cosmic().powers


LENGTH_POWERS = {"cm": Fraction(1)}


def raw(*quantities: Any) -> list[Any]:
    """The values alone, of quantities and of plain ones as they are. All that are lengths must have the same unit, powers of a and h included."""
    lengths = [q.unit for q in quantities if isinstance(q, Quantity) and q.unit.physical().powers == LENGTH_POWERS]
    if any(u != lengths[0] for u in lengths):
        raise ValueError("lengths of different units: " + ", ".join(map(str, lengths)))
    return [q.value if isinstance(q, Quantity) else q for q in quantities]
