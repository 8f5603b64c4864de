"""Engine settings. One object per session of work; nothing is global but the default."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .units import Unit


@dataclass
class EngineConf:
    """Switches and registries that a snapshot is opened with.

    ``strict_units``: raise where a column has no unit, instead of hiding the column. ``only_user_functions``: leave the built-in
    derived columns out. ``aliases``: short name by key. ``user_functions``: key -> (dependencies or None, function of a snapshot that gives a Column). ``user_units``: (species, block) -> unit. ``user_aggregates``: name -> function of a Column that gives an aggregate.
    """

    strict_units: bool = False
    only_user_functions: bool = False
    verbose: bool = False
    aliases: dict[str, str] = field(default_factory=dict)
    user_functions: dict[str, tuple[tuple[str, ...] | None, Callable]] = field(default_factory=dict)
    user_units: dict[tuple[str, str], Unit] = field(default_factory=dict)
    user_aggregates: dict[str, Callable] = field(default_factory=dict)

    def add_user_function(self, key: str, function: Callable, depends: tuple[str, ...] | None = None) -> None:
        """A derived column; without ``depends`` it is taken to be possible always."""
        check_key(key)
        self.user_functions[key] = (depends, function)

    def add_user_unit(self, species: str, block: str, unit: str | Unit) -> None:
        """A unit for a column; raises where the built-in unit differs."""
        from .unit_rules import builtin_unit

        new = Unit.parse(unit) if isinstance(unit, str) else unit
        known = builtin_unit(species, block)
        if known is not None and known != new:
            raise ValueError(f"{species}/{block} already has the unit {known}")
        self.user_units[species, block] = new

    def add_user_aggregate(self, name: str, function: Callable) -> None:
        """An aggregate by name: a composition of built-in ones, or a grouped pandas UDF."""
        if name in self.user_aggregates:
            raise ValueError(f"there is an aggregate {name} already")
        self.user_aggregates[name] = function

    def set_aliases(self, aliases: Mapping[str, str]) -> None:
        """Short names by key; both must be unique."""
        if len(set(aliases.values())) != len(aliases):
            raise ValueError("aliases must differ from each other")
        self.aliases = dict(aliases)

    def resolve(self, name: str) -> str:
        """The key behind an alias."""
        return next((k for k, v in self.aliases.items() if v == name), name)

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> EngineConf:
        """Settings from a JSON file, on the driver's disk or, with a session, on any file system that Spark reads. Data only: nothing in it is executed."""
        if spark is not None:
            from .sources.files import read_json

            return EngineConf.of(read_json(spark, path))
        with open(path) as f:
            return EngineConf.of(json.load(f))

    @staticmethod
    def of(raw: Mapping) -> EngineConf:
        conf = EngineConf(bool(raw.get("strict_units", False)), bool(raw.get("only_user_functions", False)), bool(raw.get("verbose", False)))
        conf.set_aliases(raw.get("aliases", {}))
        for name, unit in raw.get("user_units", {}).items():
            species, _, block = name.partition("/")
            conf.add_user_unit(species, block, unit)
        return conf


def check_key(key: str) -> tuple[int, str]:
    """Particle type and block of a key such as ``0_Masses``."""
    if len(key) < 3 or not key[0].isdigit() or key[1] != "_":
        raise KeyError(f"{key!r} is no key: a digit, an underscore and a block name are expected")
    return int(key[0]), key[2:]
