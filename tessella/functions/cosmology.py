"""Cosmological distances and times as Column expressions.

The integrals over redshift are Gauss-Legendre sums with fixed nodes: a plain expression that stays in
generated code, exact to well below 1e-7 over the redshifts in use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants in SI units.
LIGHT = 299792458.0
PARSEC = 3.08567758135e16
GRAVITY = 6.673e-11
DAY = 86400.0
NODES = 24


@dataclass(frozen=True)
class Cosmology:
    h0: float = 67.66
    lambda0: float = 0.6889
    matter0: float = 0.3111
    radiation0: float = 0.0

    @cached_property
    def curvature0(self) -> float:
        return 1.0 - (self.lambda0 + self.matter0 + self.radiation0)

    @property
    def h0_per_second(self) -> float:
        return self.h0 / 1000 / PARSEC

    @property
    def hubble_distance(self) -> float:
        """c / H0 in Mpc."""
        return LIGHT / self.h0_per_second / (1e6 * PARSEC)

    def expansion(self, z: Column) -> Column:
        """H(z) / H0."""
        y = 1 + z
        return F.sqrt(self.lambda0 + self.curvature0 * y * y + self.matter0 * y * y * y + self.radiation0 * y * y * y * y)

    @staticmethod
    def integral(f: Callable[[Column], Column], low: Column, high: Column) -> Column:
        """Over [low, high] by Gauss-Legendre."""
        x, w = np.polynomial.legendre.leggauss(NODES)
        half, middle = (high - low) / 2, (high + low) / 2
        total = None
        for xi, wi in zip(x.tolist(), w.tolist()):
            term = wi * f(middle + half * xi)
            total = term if total is None else total + term
        return half * total

    def proper_distance(self, z: Column) -> Column:
        """Mpc."""
        return self.integral(lambda t: 1 / self.expansion(t), F.lit(0.0), z) * self.hubble_distance

    def angular_distance(self, z: Column) -> Column:
        return self.proper_distance(z) / (1 + z)

    def luminosity_distance(self, z: Column) -> Column:
        return self.proper_distance(z) * (1 + z)

    def distance_modulus(self, z: Column) -> Column:
        return 5 * (F.log10(self.luminosity_distance(z) * 1e6) - 1)

    def absolute_conversion(self, z: Column) -> Column:
        return self.distance_modulus(z) - 2.5 * F.log10(1 + z)

    def comoving_volume(self, z: Column) -> Column:
        """Mpc^3 over the full sky.  The distance's own derivative is 1 / E, so its square integrates to a third of its cube."""
        d = self.proper_distance(z)
        return 4 * np.pi / 3 * d * d * d

    def age(self, z: Column) -> Column:
        """Ga since the start: the integral to infinity in terms of a = 1 / (1 + z), squared for a smooth integrand."""
        def integrand(s: Column) -> Column:
            a = s * s
            return 2 * s / (a * self.expansion(1 / a - 1))

        return self.integral(integrand, F.lit(0.0), F.sqrt(1 / (1 + z))) / self.h0_per_second / (365 * DAY) / 1e9

    def lookback(self, z: Column) -> Column:
        return self.age(F.lit(0.0)) - self.age(z)

    def critical_density(self, z: Column) -> Column:
        """g / cm^3."""
        h = self.h0_per_second * self.expansion(z)
        return 3 * h * h / (8 * np.pi * GRAVITY) / 1000

    def arcsec_tangential(self, z: Column) -> Column:
        """kpc covered by an arcsecond."""
        return self.angular_distance(z) * 1000 * np.pi / 180 / 3600


def velocity_from_z(z: Column) -> Column:
    """km/s."""
    y = (1 + z) * (1 + z)
    return LIGHT * (y - 1) / (y + 1) / 1000


def z_from_velocity(v: Column) -> Column:
    c = LIGHT / 1000
    return F.sqrt((c + v) / (c - v)) - 1


# Rest wavelengths of spectral lines in Angstrom.
LINES = {
    "siired": 6731.0, "sii": 6724.0, "siiblue": 6717.0, "niired": 6584.0, "nii": 6566.0, "halpha": 6562.8, "niiblue": 6548.0,
    "oiiired-vis": 5007.0, "oiii-vis": 4983.0, "oiiiblue-vis": 4959.0, "hbeta": 4861.36, "heii-vis": 4686.0, "hgamma": 4340.46,
    "hdelta": 4101.74, "hepsilon": 3970.07, "neiii": 3869.0, "oiired": 3729.0, "oii": 3727.5, "oiiblue": 3726.0, "blimit": 3646.0,
    "mgiired": 2803.0, "mgii": 2799.5, "mgiiblue": 2796.0, "ciiired": 1909.0, "ciii": 1908.0, "ciiiblue": 1907.0, "siiiired": 1892.0,
    "siiii": 1887.5, "siiiiblue": 1883.0, "oiiired-uv": 1666.0, "oiii-uv": 1663.5, "oiiiblue-uv": 1661.0, "heii-uv": 1640.0,
    "civred": 1551.0, "civ": 1549.5, "civblue": 1548.0, "nv": 1240.0, "lyalpha": 1215.67, "lybeta": 1025.7, "lygamma": 972.54,
    "lydelta": 949.74, "lyepsilon": 937.80, "lylimit": 912.0,
}


def line_redshift(observed: Column, rest: Column) -> Column:
    return observed / rest - 1


def line_observed(z: Column, rest: Column) -> Column:
    return rest * (1 + z)


def line_table(spark):
    """name, wavelength."""
    return spark.createDataFrame(sorted(LINES.items()), "name string, wavelength double")
