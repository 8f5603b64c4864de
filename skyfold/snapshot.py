"""Snapshots: one DataFrame for each particle type, with lazily derived, unit-tagged columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conf import EngineConf, check_key
from .cosmology import Cosmology
from .functions.derived import BUILTIN, Derived, feasible
from .functions.geometry import shell
from .operators import aggregates
from .unit_rules import unit_for
from .units import CodeUnits, Quantity, Unit


class Snapshot:
    """Particle tables with metadata.

    ``types``: DataFrames by particle type, vectors as structs x, y, z and positions in ``Coordinates``. ``header``: Time, Redshift, BoxSize, MassTable and so on; ``parameters``:
    HubbleParam, ComovingIntegrationOn, units in cgs, Omega0...; ``config``: GAMMA, ISOTHERMAL. Units hold for this snapshot, not for the process.
    Keys are ``<type>_<block>``. Looking one up gives an expression; nothing is read before an action.
    """

    def __init__(self, types: Mapping[int, DataFrame], header: Mapping | None = None, parameters: Mapping | None = None, config: Mapping | None = None, conf: EngineConf | None = None, units: Mapping[str, str] | None = None, row_id: str = "row_id"):
        self.types, self.header = dict(types), dict(header or {})
        self.parameters, self.config = dict(parameters or {}), dict(config or {})
        self.conf = conf or EngineConf()
        self.row_id = row_id
        self._units = {k: u for k, u in (units or {}).items()}
        self._forgotten: set[str] = set()
        p = self.parameters
        self.code = CodeUnits(p.get("UnitLength_in_cm", CodeUnits.length), p.get("UnitMass_in_g", CodeUnits.mass), p.get("UnitVelocity_in_cm_per_s", CodeUnits.velocity))

    # -- metadata

    @property
    def comoving(self) -> bool:
        return bool(self.parameters.get("ComovingIntegrationOn", 0))

    @property
    def h(self) -> float:
        """Hubble parameter; zero in the file means one."""
        return float(self.parameters.get("HubbleParam", 1) or 1)

    @property
    def a(self) -> float:
        return float(self.header.get("Time", 1)) if self.comoving else 1.0

    @property
    def z(self) -> float:
        return 1 / self.a - 1

    @property
    def gamma(self) -> float:
        """Adiabatic index."""
        if "GAMMA" in self.config:
            return float(self.config["GAMMA"])
        return 1.0 if "ISOTHERMAL" in self.config else 5 / 3

    @property
    def cosmology(self) -> Cosmology:
        p = self.parameters
        return Cosmology(self.h, float(p.get("Omega0", 0.3)), float(p.get("OmegaLambda", 0.7)), float(p.get("OmegaBaryon", 0.0)))

    def age(self, z: float | None = None) -> float:
        """Gyr since the big bang, at this snapshot's redshift unless given."""
        return self.cosmology.age(self.z if z is None else z)

    def lookback_time(self, z: float | None = None) -> float:
        return self.cosmology.lookback_time(self.z if z is None else z)

    def rho_crit(self, z: float | None = None) -> float:
        return self.cosmology.rho_crit(self.z if z is None else z)

    def species(self, parttype: int) -> str:
        """Type 0 is gas; others go by the fields they hold, stars before black holes."""
        if parttype == 0:
            return "voronoi_cells"
        names = self.types[parttype].columns if parttype in self.types else []
        if any(n.startswith("GFM_") for n in names):
            return "stars"
        return "black_holes" if any(n.startswith("BH_") for n in names) else "dark_matter"

    # -- columns

    def stores(self, key: str) -> bool:
        t, block = check_key(key)
        return t in self.types and block in self.types[t].columns and key not in self._forgotten

    def _mass_table(self, t: int) -> float:
        table = self.header.get("MassTable", [])
        return float(table[t]) if t < len(table) else 0.0

    def functions(self) -> dict[str, Derived]:
        """Derived columns that this snapshot can give: the user's own, then built-in ones they don't replace."""
        own = {k: Derived(tuple(needs or ()), build) for k, (needs, build) in self.conf.user_functions.items()}
        built = {} if self.conf.only_user_functions else {k: d for k, d in BUILTIN.items() if k not in own}
        stored = [f"{t}_{c}" for t, df in self.types.items() for c in df.columns if f"{t}_{c}" not in self._forgotten]
        stored += [f"{t}_Masses" for t in self.types if self._mass_table(t) > 0]
        return {k: d for k, d in feasible(stored, own | built).items() if k not in stored}

    def col(self, key: str) -> Column:
        """The expression behind a key or an alias."""
        key = self.conf.resolve(key)
        t, block = check_key(key)
        if self.stores(key):
            return F.col(f"`{block}`")
        if t not in self.types:
            raise KeyError(f"no particles of type {t}")
        if block == "Masses" and self._mass_table(t) > 0 and key not in self.conf.user_functions:
            return F.lit(self._mass_table(t))
        known = self.functions()
        if key not in known:
            raise KeyError(f"{key} is neither stored nor derivable here")
        if self.conf.verbose:
            print(f"deriving {key}")
        return known[key].build(self)

    __getitem__ = col

    def unit(self, key: str) -> Unit | None:
        """The unit of a key, or None; raises for None under strict units."""
        key = self.conf.resolve(key)
        t, block = check_key(key)
        species = self.species(t)
        if key in self._units:
            return Unit.parse(self._units[key], self.code)
        if (species, block) in self.conf.user_units:
            return self.conf.user_units[species, block]
        d = BUILTIN.get(key)
        unit = None
        if d is not None and d.unit is not None and not self.stores(key):
            unit = self._derived_unit(d.unit)
        else:
            unit = unit_for(species, block, self.comoving, self.h)
            if unit is not None and unit.text is not None:
                unit = Unit.parse(unit.text, self.code)
            elif unit is not None:
                unit = self._rescaled(unit, species, block)
        if unit is None and self.conf.strict_units:
            raise KeyError(f"no unit is known for {key}")
        return unit

    def _rescaled(self, unit: Unit, species: str, block: str) -> Unit:
        from .unit_rules import builtin_unit

        base = builtin_unit(species, block) or builtin_unit("dark_matter", block)
        scale = Unit.parse(base.text, self.code).scale
        return Unit(scale, unit.powers)

    def _derived_unit(self, text: str) -> Unit | None:
        out, sign = Unit(), 1
        for word in text.split():
            if word == "/":
                sign = -1
            elif word != "1":
                name, _, power = word.partition("^")
                if name.startswith("{"):
                    one = self.unit(name[1:-1])
                    if one is None:
                        return None
                else:
                    one = Unit.parse(name, self.code)
                from fractions import Fraction

                out = out * one ** (Fraction(power.strip("()")) * sign if power else sign)
                sign = 1
        return out

    def quantity(self, key: str) -> Quantity:
        """Column with its unit, at the snapshot's a and h."""
        return Quantity(self.col(key), self.unit(key) or Unit(), self.a, self.h, self.comoving, self.code)

    def frame(self, parttype: int, *keys: str, extra: Sequence[str] = (), to_physical: bool = False) -> DataFrame:
        """One type's rows with the given keys as columns named by their blocks (or aliases), units in the column metadata."""
        out = []
        for key in keys:
            full = self.conf.resolve(key)
            q = self.quantity(full)
            q = q.to_physical if to_physical and self.unit(full) is not None else q
            name = self.conf.aliases.get(full, check_key(full)[1])
            out.append(q.value.alias(name, metadata={"unit": str(q.unit)}))
        return self.types[parttype].select(*extra, *out)

    def info(self, parttype: int) -> dict[str, list[str]]:
        """Stored columns with and without a unit, and those that can be derived."""
        names = [c for c in self.types[parttype].columns if c != self.row_id]
        has = {c: unit_for(self.species(parttype), c, self.comoving, self.h) is not None or (self.species(parttype), c) in self.conf.user_units for c in names}
        return {"with_unit": sorted(c for c in names if has[c]), "without_unit": sorted(c for c in names if not has[c]), "derived": sorted(k for k in self.functions() if check_key(k)[0] == parttype)}

    def remove(self, key: str) -> None:
        """Forget a stored column."""
        self._forgotten.add(self.conf.resolve(key))

    # -- selection

    def _with(self, types: Mapping[int, DataFrame]) -> Snapshot:
        new = type(self).__new__(type(self))
        new.__dict__ = dict(self.__dict__)
        new.types = {**self.types, **types}
        new._forgotten = set(self._forgotten)
        return new

    def select(self, parttype: int, rows: Column | DataFrame) -> Snapshot:
        """Rows of one type by a predicate, or by a DataFrame of row ids; other types stay. Selections compose."""
        df = self.types[parttype]
        kept = df.filter(rows) if isinstance(rows, Column) else df.join(rows.select(self.row_id).distinct(), self.row_id, "left_semi")
        return self._with({parttype: kept})

    def radial_select(self, center: Sequence[float], r_max: float, r_min: float = 0.0, parttype: int | None = None) -> Snapshot:
        """Rows in a spherical shell, of all types unless one is named."""
        which = self.types if parttype is None else {parttype: self.types[parttype]}
        return self._with({t: df.filter(shell(F.col("Coordinates"), center, r_max, r_min)) for t, df in which.items()})

    # -- sums

    def _together(self, parttype: int | None, *keys: str) -> DataFrame:
        """Columns of one type, or of all types one under the other with their type."""
        frames = [self.types[t].select(F.lit(t).alias("parttype"), *[self.col(f"{t}_{k}").alias(k) for k in keys]) for t in sorted(self.types) if parttype in (None, t)]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def sum_of(self, key: str, exact: int | None = None) -> DataFrame:
        return aggregates.sum_of(self.types[check_key(self.conf.resolve(key))[0]], self.col(key), exact=exact)

    def aggregate(self, name: str, key: str, by: Sequence[str] = ()) -> DataFrame:
        """A user's aggregate of a key, under its own name, over all rows or by stored columns."""
        df = self.types[check_key(self.conf.resolve(key))[0]]
        return df.groupBy(*by).agg(self.conf.user_aggregates[name](self.col(key)).alias(name))

    def center_of_mass(self, parttype: int | None = None, exact: int | None = None) -> DataFrame:
        """For each type, and over all types (parttype null) where none is named: one pass over the union of the types."""
        df = self._together(parttype, "Masses", "Coordinates")
        if parttype is not None:
            return aggregates.center_of_mass(df, F.col("Masses"), F.col("Coordinates"), ["parttype"], exact)
        both = df.withColumn("parttype", F.explode(F.array(F.col("parttype"), F.lit(None).cast("int"))))
        return aggregates.center_of_mass(both, F.col("Masses"), F.col("Coordinates"), ["parttype"], exact)

    def total_angular_momentum(self, center: Sequence[float], parttype: int | None = None, exact: int | None = None) -> DataFrame:
        df = self._together(parttype, "Masses", "Coordinates", "Velocities")
        return aggregates.angular_momentum(df, F.col("Masses"), F.col("Coordinates"), F.col("Velocities"), center, ["parttype"], exact)
