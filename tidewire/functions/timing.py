"""Ages, decay and polling schedule as expressions of an explicit moment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.ids import col

#: Lower edges of the age bands in minutes, the last one the end (fixed values).
BAND_EDGES = (10, 15, 22, 33, 48, 70, 105, 150, 220, 320, 420, 570)
REFERENCE_AGE = 480
#: Ages in minutes at which a post is sampled, and the age beyond which it is not (fixed values).
SAMPLE_OFFSETS = (15, 30, 60, 120, 240, 480, 1440, 2880)
HORIZON = 49 * 60


def seconds(c: Column | str) -> Column:
    """A timestamp as seconds with fraction."""
    return F.unix_micros(col(c).cast("timestamp")) / 1e6


def age_minutes(later: Column | str, earlier: Column | str) -> Column:
    return (seconds(later) - seconds(earlier)) / 60


def band_of(minutes: Column, edges: tuple[int, ...] = BAND_EDGES) -> Column:
    """The half-open band of an age, named for its lower edge; null outside all."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high in zip(edges, edges[1:]):
        out = out.when((minutes >= low) & (minutes < high), F.lit(f"{low}m"))
    return out


def reference_band(edges: tuple[int, ...] = BAND_EDGES, age: int = REFERENCE_AGE) -> str:
    """The band that holds the reference age, or the last one."""
    return next((f"{a}m" for a, b in zip(edges, edges[1:]) if a <= age < b), f"{edges[-2]}m")


def decay(now: Column, at: Column, half_life_days: float) -> Column:
    """A weight that halves with every half-life."""
    return F.pow(F.lit(0.5), (seconds(now) - seconds(at)) / 86_400 / half_life_days)


@dataclass(frozen=True)
class Schedule:
    """Minutes throughout; ``share`` is the part of a mean gap that an idle channel waits."""

    least: float = 30
    most: float = 720
    share: float = 0.25
    failure_cap: float = 1440
    floor: float = 10

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.most:
            raise ValueError("idle interval must be positive and ordered")


def next_sample(age: Column, offsets: tuple[int, ...] = SAMPLE_OFFSETS) -> Column:
    """The first sample age after an age in minutes; null past the last one."""
    return F.array_min(F.filter(F.array(*[F.lit(float(o)) for o in offsets]), lambda o: o > age))


def idle_interval(posts_per_day: Column, s: Schedule = Schedule()) -> Column:
    """Minutes to wait for a channel without live posts; the longest if its rate is unknown or zero."""
    gap = F.when(posts_per_day > 0, F.lit(1440.0) / posts_per_day * s.share)
    return F.coalesce(F.greatest(F.lit(s.least), F.least(F.lit(s.most), gap)), F.lit(s.most))


def backoff(empty: Column, failures: Column) -> Column:
    return F.pow(F.lit(1.5), F.least(empty, F.lit(4))) * F.pow(F.lit(2.0), F.least(failures, F.lit(6)))


def next_poll(now: Column, last_poll: Column, next_live: Column, posts_per_day: Column, empty: Column, failures: Column, s: Schedule = Schedule()) -> Column:
    """When to poll next, in minutes since the epoch: the next sample of a live post, else the idle wait stretched by backoff.

    Backoff stretches the idle wait alone, and only a failing channel's wait is capped. Never sooner than the floor after
    the last poll, never before now.
    """
    wait = idle_interval(posts_per_day, s) * backoff(empty, failures)
    idle = now + F.when(failures > 0, F.least(wait, F.lit(s.failure_cap))).otherwise(wait)
    return F.greatest(F.coalesce(next_live, idle), F.coalesce(last_poll + s.floor, now), now)


def quiet_until(at: Column, start_hour: int, end_hour: int, zone: str = "UTC") -> Column:
    """The moment at which the quiet hours that hold ``at`` end; ``at`` itself outside of them."""
    local = F.from_utc_timestamp(at, zone)
    day = F.date_trunc("day", local)
    wraps = (F.hour(local) >= start_hour) if start_hour > end_hour else F.lit(False)
    ends = F.when(wraps, day + F.expr("interval 1 day")).otherwise(day) + F.make_dt_interval(hours=F.lit(end_hour))
    return F.when(in_quiet_window(at, start_hour, end_hour, zone), F.to_utc_timestamp(ends, zone)).otherwise(at)


def window_size(posts_per_day: Column) -> Column:
    """How many recent posts one poll reads."""
    return F.greatest(F.lit(10), F.least(F.lit(100), F.floor(F.coalesce(posts_per_day, F.lit(0.0)) * 49 / 24) + 2)).cast("int")


def in_quiet_window(at: Column, start_hour: int, end_hour: int, zone: str = "UTC") -> Column:
    """Whether a moment lies in the quiet hours of a zone; the window may pass midnight, equal hours mean none."""
    hour = F.hour(F.from_utc_timestamp(at, zone))
    if start_hour == end_hour:
        return F.lit(False)
    inside = (hour >= start_hour) & (hour < end_hour)
    return inside if start_hour < end_hour else (hour >= start_hour) | (hour < end_hour)


def digest_due(last: Column, now: Column, hour: int, zone: str = "UTC") -> Column:
    """Whether the daily digest is due: the hour has come and none was sent on this day."""
    local = F.from_utc_timestamp(now, zone)
    return (F.hour(local) >= hour) & (last.isNull() | (F.to_date(F.from_utc_timestamp(last, zone)) < F.to_date(local)))


def age_phrase(minutes: Column) -> Column:
    """A short age: minutes under an hour, hours under a day, else days."""
    part = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(minutes < 60, part(minutes, "m")).when(minutes < 1440, part(minutes / 60, "h")).otherwise(part(minutes / 1440, "d"))
