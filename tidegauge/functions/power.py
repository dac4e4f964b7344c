"""Voltage, activity and power as functions of frequency and idle share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge import fixed_values as fixed


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp to an interval; NULL stays NULL."""
    clamped = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), clamped)


def voltage(freq_mhz: Column) -> Column:
    """Supply voltage, linear between the lowest and highest frequency."""
    span = fixed.FREQ_MAX_MHZ - fixed.FREQ_MIN_MHZ
    share = clip((freq_mhz - F.lit(fixed.FREQ_MIN_MHZ)) / F.lit(span))
    return F.lit(fixed.VOLT_MIN) + share * F.lit(fixed.VOLT_MAX - fixed.VOLT_MIN)


def activity(idle: Column, full_scale: float = fixed.IDLE_FULL_SCALE) -> Column:
    """Busy share from the idle reading, with a fixed share where it is missing."""
    busy = clip(F.lit(1.0) - idle / F.lit(full_scale))
    return F.coalesce(busy, F.lit(fixed.ACTIVITY_WHEN_UNKNOWN))


def power(freq_mhz: Column, busy: Column) -> Column:
    """Static plus switched power; switched power is C·V²·f over the busy cores."""
    top_hz = fixed.FREQ_MAX_MHZ * 1e6
    capacitance = (fixed.POWER_FULL_W - fixed.POWER_STATIC_W) / (
        fixed.VOLT_MAX**2 * top_hz * fixed.CORES
    )
    volts = voltage(freq_mhz)
    switched = volts * volts * (freq_mhz * F.lit(1e6)) * F.lit(capacitance * fixed.CORES)
    return F.lit(fixed.POWER_STATIC_W) + switched * busy
