"""Transport times and costs as columns. Times are counted in whole minutes or seconds, so nothing drifts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of handling for a unit of volume, penalty for a unit and late hour, and the slack of a count.
MINUTES_PER_UNIT, PENALTY, SLACK = 0.01, 0.4, 1e-9


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def travel_minutes(hours) -> Column:
    return F.ceil(F.round(col(hours) * 60, 9)).cast("int")


def handling_minutes(volume, consolidated: bool = False) -> Column:
    return F.ceil(F.round(col(volume) * MINUTES_PER_UNIT * (2 if consolidated else 1), 9)).cast("int")


def plus_minutes(time, minutes) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(col(time)) + col(minutes) * 60)


def sla_deadline(time, days) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(col(time)) + (col(days) * 86400).cast("long"))


def late_hours(done, deadline) -> Column:
    """Full hours begun after the deadline; 0 in time."""
    return F.greatest(F.lit(0), F.ceil((F.unix_timestamp(col(done)) - F.unix_timestamp(col(deadline))) / 3600)).cast("int")


def sla_penalty(volume, hours) -> Column:
    return col(volume) * col(hours) * PENALTY


def vehicle_leg_cost(hourly, hours, per_km, km) -> Column:
    """Driving only, halves to even; 0 where the lane is unknown."""
    return F.coalesce(F.bround(col(hourly) * col(hours) + col(per_km) * col(km), 0), F.lit(0.0))


def handling_cost(volume, hourly, touches=2) -> Column:
    return F.bround(col(touches) * handling_minutes(volume) / 60 * col(hourly), 0) if isinstance(touches, (str, Column)) else F.bround(F.lit(touches) * handling_minutes(volume) / 60 * col(hourly), 0)


def vehicle_count(volume, capacity, most=None) -> Column:
    n = F.ceil(col(volume) / col(capacity) - SLACK).cast("int")
    return F.least(n, col(most)) if most is not None else n


def arrival_day(day, slot_hour, hours) -> Column:
    return F.date_add(col(day), F.floor((col(slot_hour) + col(hours)) / 24).cast("int"))


def next_dispatch(day, slot_hour, hours) -> tuple[Column, Column]:
    """(day, slot) of the first slot after the arrival: 09:00 or 17:00, strictly later, else 09:00 of the next day."""
    total = col(slot_hour) + col(hours)
    hour, days = F.pmod(total, F.lit(24)), F.floor(total / 24).cast("int")
    slot = F.when(hour < 9, "09:00").when(hour < 17, "17:00").otherwise("09:00")
    return F.date_add(col(day), days + F.when(hour < 17, 0).otherwise(1)), slot


def min_occupancy(lane_total, capacity, slots_left, taper: int = 4, base: float = 0.10) -> Column:
    """Least load of a vehicle: base, or what the lane's whole demand can fill; falling to 0 over the last slots."""
    ceiling = F.least(F.lit(1.0), col(lane_total) / col(capacity))
    return F.least(F.lit(base), ceiling) * F.least(F.lit(1.0), col(slots_left) / F.lit(taper))
