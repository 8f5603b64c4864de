from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfold.conf import EngineConf, check_key
from skyfold.cosmology import Cosmology
from skyfold.orientation import Orientation, any_perpendicular
from skyfold.unit_rules import builtin_unit, unit_for
from skyfold.units import CodeUnits, Quantity, Unit, stacked


def test_moving_in_time_keeps_physical_or_comoving_values():
    q = Quantity(100.0, "kpc small_a", a=1.0)
    moved, kept = q.adjust_time(a=0.5), q.set_time(a=0.5)
    assert q.to_physical.value == 100 and kept.to_physical.value == 50
    assert moved.value == 200 and moved.to_physical.value == pytest.approx(100)
    per = Quantity(100.0, "kpc small_a^-1", a=1.0)
    assert per.adjust_time(z=1.0).value == 50 and per.set_time(z=1.0).to_physical.value == 200


def test_conversions_agree_with_each_other():
    q = Quantity(3.0, "code_density small_h2 / small_a3", a=0.5, h=0.7)
    assert q.no_small_h.value == pytest.approx(3 * 0.49)
    assert q.to_physical.value == pytest.approx(3 * 0.49 * 8)
    assert q.to_any("g / cm3").value == pytest.approx(q.to_physical.cgs.value)
    assert q.to("Msun / kpc3").unit.power("a") == -3
    back = q.to_physical.to_comoving("code_density small_h2 / small_a3")
    assert back.value == pytest.approx(3.0)
    assert q.si.value == pytest.approx(q.cgs.value * 1000)
    assert q.astro.in_code.cgs.value == pytest.approx(q.cgs.value)


def test_half_powers_and_energy_kelvin():
    u = Unit.parse("code_pressure^(1/2) small_a^-2 small_h")
    assert u.power("g") * 2 == 1 and u.power("a") == -2
    assert (u * u) == Unit.parse("code_pressure small_a^-4 small_h2")
    assert Quantity(1.0, "keV").to("K").value == pytest.approx(1.16045e7, rel=1e-4)
    assert Unit.parse("uG").powers == Unit.parse("erg^(1/2) / cm^(3/2)").powers


def test_bad_operations_raise():
    a, b = Quantity(1.0, "kpc", a=1.0), Quantity(1.0, "kpc", a=0.5)
    for op in (lambda: a + b, lambda: a * b, lambda: a - b, lambda: a / b, lambda: a.to("g"), lambda: Unit.parse("parrot"), lambda: stacked([a, Quantity(1.0, "pc")])):
        with pytest.raises(ValueError):
            op()
    assert (a + Quantity(1000.0, "pc")).value == pytest.approx(2)
    assert stacked([a, a]).value.tolist() == [1, 1]
    assert "kpc" in a.label("r") and Quantity(1.0, "kpc small_a").label("r").count("a") >= 1


def test_code_units_are_per_system():
    other = CodeUnits(length=1.0, mass=1.0, velocity=1.0)
    assert Quantity(5.0, "code_length", code=other).cgs.value == 5


def test_unit_rules():
    assert builtin_unit("voronoi_cells", "Velocities") == Unit.parse("code_velocity small_a^(1/2)")
    assert builtin_unit("groups", "GroupVel").power("a") == -1
    assert builtin_unit("subhalos", "SubhaloMassInRadType") == Unit.parse("code_mass / small_h")
    assert builtin_unit("groups", "Group_R_Crit200").power("h") == -1
    assert unit_for("voronoi_cells", "Density", comoving=False, h=1.0).powers == Unit.parse("code_density").powers
    assert builtin_unit("voronoi_cells", "NoSuchThing") is None


def test_conf():
    conf = EngineConf()
    with pytest.raises(ValueError):
        conf.add_user_unit("voronoi_cells", "Density", "kpc")
    conf.add_user_unit("voronoi_cells", "Spin", "kpc km / s")
    with pytest.raises(ValueError):
        conf.set_aliases({"0_A": "x", "0_B": "x"})
    for bad in ("Masses", "0Masses", "x_Masses"):
        with pytest.raises(KeyError):
            check_key(bad)


def test_cosmology_of_an_empty_and_a_matter_universe():
    milne = Cosmology(0.7, 1e-12, 0.0)
    assert milne.age(0) == pytest.approx(milne.hubble_time_gyr, rel=1e-4)
    flat = Cosmology(0.7, 1.0, 0.0)
    assert flat.age(0) == pytest.approx(2 / 3 * flat.hubble_time_gyr, rel=1e-6)
    real = Cosmology(0.6774, 0.3089, 0.6911)
    assert real.age(0) == pytest.approx(13.8, abs=0.05)
    assert real.age(1) + real.lookback_time(1) == pytest.approx(real.age(0))
    assert real.rho_crit(0) == pytest.approx(1.8784e-29 * 0.6774**2, rel=1e-3)


def test_rotations_about_axes_and_own_vectors_agree():
    one = Orientation(normal=(0, 0, 1), perp1=(1, 0, 0))
    for axis, own in (("x", "perp1"), ("y", "perp2"), ("z", "normal")):
        a, b = getattr(one, f"rotate_around_{axis}")(degrees=33), getattr(one, f"rotate_around_{own}")(degrees=33)
        assert a == b and a != one
    assert one.copy() == one
    with pytest.raises(ValueError):
        Orientation(normal=(0, 0, 1), perp1=(0, 1, 1))
    with pytest.raises(ValueError):
        one.rotate_around_x()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=3).filter(lambda v: sum(x * x for x in v) > 1e-3), st.floats(-180, 180))
def test_triads_stay_orthonormal_and_right_handed(v, angle):
    o = Orientation(normal=v).rotate_around_perp1(degrees=angle)
    assert np.allclose(o.matrix.T @ o.matrix, np.eye(3), atol=1e-12)
    assert np.linalg.det(o.matrix) == pytest.approx(1)
    assert abs(any_perpendicular(v) @ np.asarray(v)) < 1e-9
