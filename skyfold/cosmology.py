"""Ages and densities of a flat or curved Lambda-CDM background."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .units import YEAR

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
MPC_KM = 3.0856775814913674e19
GRAVITY = 6.6743e-8


@dataclass(frozen=True)
class Cosmology:
    """``h``: Hubble parameter in 100 km/s/Mpc."""

    h: float = 0.7
    omega_m: float = 0.3
    omega_lambda: float = 0.7
    omega_b: float = 0.045

    @property
    def omega_k(self) -> float:
        return 1 - self.omega_m - self.omega_lambda

    @property
    def hubble_time_gyr(self) -> float:
        return MPC_KM / (100 * self.h) / (YEAR * 1e9)

    def efunc(self, z: float | np.ndarray) -> float | np.ndarray:
        """H(z) / H(0)."""
        return np.sqrt(self.omega_m * (1 + z) ** 3 + self.omega_k * (1 + z) ** 2 + self.omega_lambda)

    def _time(self, a0: float, a1: float) -> float:
        # with a = x**2, da / (a E(a)) has no singularity at the big bang
        lo, hi = np.sqrt(a0), np.sqrt(a1)
        x = 0.5 * (hi - lo) * _NODES + 0.5 * (hi + lo)
        return float(self.hubble_time_gyr * 0.5 * (hi - lo) * (_WEIGHTS * 2 / (x * self.efunc(1 / x**2 - 1))).sum())

    def age(self, z: float) -> float:
        """Gyr since the big bang."""
        return self._time(0.0, 1 / (1 + z))

    def lookback_time(self, z: float) -> float:
        """Gyr from redshift z to now."""
        return self._time(1 / (1 + z), 1.0)

    def rho_crit(self, z: float) -> float:
        """Critical density in g/cm^3."""
        rate = 100 * self.h * self.efunc(z) / MPC_KM
        return float(3 * rate**2 / (8 * np.pi * GRAVITY))
