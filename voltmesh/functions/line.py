"""Dynamic line rating after IEEE 738."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basic import PI, div, larger, num


def line_limit(psi: Column, resistance: Column, diameter: float = 0.028, surface: float = 373.0, emissivity: float = 0.6, absorptivity: float = 0.6, psi_unit: str = "deg") -> Column:
    """Ampere of one cell, from temperature, wnd100m, height, wnd_azimuth, influx_direct, solar_altitude, solar_azimuth.

    ``psi`` is the line's azimuth; its unit is degrees unless ``psi_unit`` is "rad".
    """
    ta, ts, d = F.col("temperature"), num(surface), num(diameter)
    psi = psi if psi_unit == "rad" else F.radians(psi)
    film = (ta + ts) / num(2)
    c = film - num(273.15)
    viscosity = num(1.458e-6) * F.pow(film, num(1.5)) / (c + num(383.4))
    h = F.col("height")
    density = (num(1.293) - num(1.525e-4) * h + num(6.379e-9) * h * h) / (num(1) + num(0.00367) * c)
    reynolds = d * F.col("wnd100m") * density / viscosity
    k = num(2.424e-2) + num(7.477e-5) * c - num(4.407e-9) * c * c
    angle = F.abs(F.pmod(F.col("wnd_azimuth") - psi + num(PI / 2), num(PI)) - num(PI / 2))
    wind = num(1.194) - F.cos(angle) + num(0.194) * F.cos(num(2) * angle) + num(0.368) * F.sin(num(2) * angle)
    delta = ts - ta
    low = wind * (num(1.01) + num(1.347) * F.pow(reynolds, num(0.52))) * k * delta
    high = wind * num(0.754) * F.pow(reynolds, num(0.6)) * k * delta
    still = num(3.645) * F.sqrt(density) * F.pow(d, num(0.75)) * F.pow(delta, num(1.25))
    convection = larger(larger(low, high), still)
    radiation = num(17.8) * d * num(emissivity) * (F.pow(ts / num(100), num(4)) - F.pow(ta / num(100), num(4)))
    incidence = F.acos(F.cos(F.col("solar_altitude")) * F.cos(F.col("solar_azimuth") - psi))
    heat = num(absorptivity) * F.col("influx_direct") * d * F.sin(incidence)
    balance = div(convection + radiation - heat, resistance)
    return F.when(balance >= 0, F.sqrt(balance))
