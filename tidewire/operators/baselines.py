"""Growth baselines of counters and the scores of readings against them.

A baseline of a kind and metric is a curve (share of a post's own reference value in each age band), a factor (reference
value over the channel's mature median) and a spread, pooled and by band. Too thin a kind borrows the pooled fit whole.

Who counts where: curves are fitted on every channel that has a kind; mature medians on seeds that are no chats and did not
fail for good; scores are given to posts of seeds that are no chats, an album being its first part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.robust import MAD_SCALE, median
from tidewire.functions.timing import BAND_EDGES, REFERENCE_AGE, age_minutes, band_of, reference_band
from tidewire.operators.medians import exact_medians
from tidewire.session import materialise
from tidewire.sources.store import completed_run

METRICS = ("views", "reactions", "forwards", "comments")
ALL = "*"


@dataclass(frozen=True)
class BaselineParams:
    """Defaults are the fixed ones; ``edges`` are in minutes."""

    mature_days: float = 28
    mature_max_days: float = 120
    min_channel_posts: int = 20
    min_band_samples: int = 20
    edges: tuple[int, ...] = BAND_EDGES
    reference_age: int = REFERENCE_AGE
    alerting: tuple[str, ...] = ("views", "reactions", "forwards")
    threshold: float = 3.3

    def __post_init__(self) -> None:
        if not 0 <= self.mature_days < self.mature_max_days:
            raise ValueError("the mature window must be ordered")
        if any(a >= b for a, b in zip(self.edges, self.edges[1:])) or self.min_band_samples < 1:
            raise ValueError("band edges must rise and a band needs a sample")


def scope(channels: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """channel_id, kind, seed (no chat), healthy (no failure for good). channels: tg_id, kind, status, is_chat; failures: tg_id, failure_kind."""
    rows = channels.select("tg_id", "kind", (F.col("status").eqNullSafe("seed") & F.col("is_chat").eqNullSafe(False)).alias("seed"))
    if failures is None:
        return rows.select(F.col("tg_id").alias("channel_id"), "kind", "seed", F.lit(True).alias("healthy"))
    bad = failures.groupBy("tg_id").agg(F.max(F.col("failure_kind").eqNullSafe("permanent")).alias("bad"))
    return rows.join(bad, "tg_id", "left").select(F.col("tg_id").alias("channel_id"), "kind", "seed", (~F.coalesce("bad", F.lit(False))).alias("healthy"))


def readings(observations: DataFrame, scoped: DataFrame, p: BaselineParams) -> DataFrame:
    """channel_id, msg_id, album, kind, seed, healthy, published_at, observed_at, metric, age, band, value: one row for each published counter of each observation.

    Readings from before publication are dropped, channels that the scope lacks too. The result is materialised, as every
    step of a fit reads it and parsing the documents each time would cost far more.
    """
    rows = observations.withColumn("age", age_minutes("observed_at", "published_at")).where("age >= 0").join(scoped, "channel_id")
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    long = rows.selectExpr("channel_id", "msg_id", "album", "kind", "seed", "healthy", "published_at", "observed_at", "age", f"stack({len(METRICS)}, {stack}) as (metric, value)")
    return materialise(long.where("value is not null").withColumn("band", band_of(F.col("age"), p.edges)))


def mature_medians(long: DataFrame, p: BaselineParams) -> DataFrame:
    """channel_id, metric, median, samples over positive values of the mature age window, half open, of healthy seeds."""
    mature = long.where(F.col("seed") & F.col("healthy") & (F.col("age") >= p.mature_days * 1440) & (F.col("age") < p.mature_max_days * 1440) & (F.col("value") > 0))
    out = mature.groupBy("channel_id", "metric").agg(median(F.col("value")).alias("median"), F.count("*").alias("samples"))
    return out.where(F.col("samples") >= p.min_channel_posts)


def fitted_on(long: DataFrame, since: Column | None = None) -> DataFrame:
    """The readings that curves, factors and spreads rest on: positive, of channels with a kind, of posts published since a moment."""
    rows = long.where("kind is not null and value > 0")
    return rows if since is None else rows.where(F.col("published_at") >= since)


def references(rows: DataFrame, p: BaselineParams) -> DataFrame:
    """The greatest positive value of each post in the reference band."""
    inside = rows.where((F.col("band") == reference_band(p.edges, p.reference_age)) & (F.col("value") > 0))
    return inside.groupBy("channel_id", "msg_id", "metric").agg(F.max("value").alias("reference"))


def with_pool(df: DataFrame) -> DataFrame:
    """Every row also under the kind of all kinds: one scan feeds both fits."""
    return df.withColumn("kind", F.explode(F.array(F.col("kind"), F.lit(ALL))))


def curves(rows: DataFrame, refs: DataFrame, p: BaselineParams) -> DataFrame:
    """kind, metric, band, fraction, samples: the median share of the post's reference value."""
    shares = rows.where("band is not null and value > 0").join(refs, ["channel_id", "msg_id", "metric"]).select("kind", "metric", "band", (F.col("value") / F.col("reference")).alias("x"))
    out = exact_medians(with_pool(materialise(shares)), ["kind", "metric", "band"], "x")
    return out.where(F.col("n") >= p.min_band_samples).select("kind", "metric", "band", F.col("median").alias("fraction"), F.col("n").alias("samples"))


def factors(rows: DataFrame, refs: DataFrame, medians: DataFrame, p: BaselineParams) -> DataFrame:
    """kind, metric, factor: the median of reference over the channel's mature median."""
    kinds = rows.select("channel_id", "kind").distinct()
    ratios = refs.join(medians.select("channel_id", "metric", "median"), ["channel_id", "metric"]).join(kinds, "channel_id").where("median > 0")
    out = exact_medians(with_pool(materialise(ratios.select("kind", "metric", (F.col("reference") / F.col("median")).alias("x")))), ["kind", "metric"], "x")
    return out.where(F.col("n") >= p.min_band_samples).select("kind", "metric", F.col("median").alias("factor"))


def residuals(rows: DataFrame, medians: DataFrame, curve: DataFrame, factor: DataFrame) -> DataFrame:
    """kind, metric, band, residual: log of value over expected, for kinds and for all kinds together; materialised."""
    seen = with_pool(rows.where("band is not null and value > 0")).join(medians.select("channel_id", "metric", "median"), ["channel_id", "metric"])
    seen = seen.join(curve.select("kind", "metric", "band", "fraction"), ["kind", "metric", "band"]).join(factor, ["kind", "metric"])
    expected = F.col("median") * F.col("factor") * F.col("fraction")
    return materialise(seen.where(expected > 0).select("kind", "metric", "band", F.ln(F.col("value") / expected).alias("residual")))


def spreads(rows: DataFrame, keys: list[str], p: BaselineParams) -> DataFrame:
    """keys, spread, samples: scaled MAD of residuals; groups too thin or without variation are absent."""
    centre = exact_medians(rows, keys, "residual").where(F.col("n") >= p.min_band_samples).select(*keys, F.col("median").alias("m"))
    away = rows.join(centre, keys).select(*keys, F.abs(F.col("residual") - F.col("m")).alias("x"))
    return exact_medians(away, keys, "x").select(*keys, (F.col("median") * MAD_SCALE).alias("spread"), F.col("n").alias("samples")).where("spread > 0")


def fit(long: DataFrame, p: BaselineParams = BaselineParams(), since: Column | None = None) -> DataFrame:
    """kind, metric, band, fraction, factor, spread (of the band, else pooled), borrowed: what scoring looks up.

    Fitted on posts published since a moment. A kind without a whole fit of its own takes the one of all kinds whole;
    without that it is absent.
    """
    rows = fitted_on(long, since)
    refs, medians = references(rows, p), materialise(mature_medians(long, p))
    curve = materialise(curves(rows, refs, p))
    factor = materialise(factors(rows, refs, medians, p))
    rest = residuals(rows, medians, curve, factor)
    pooled = spreads(rest, ["kind", "metric"], p).select("kind", "metric", F.col("spread").alias("pooled"))
    banded = spreads(rest, ["kind", "metric", "band"], p).select("kind", "metric", "band", "spread")
    own = curve.join(factor, ["kind", "metric"]).join(pooled, ["kind", "metric"]).join(banded, ["kind", "metric", "band"], "left")
    own = materialise(own.select("kind", "metric", "band", "fraction", "factor", F.coalesce("spread", "pooled").alias("spread")))
    wanted = rows.select("kind", "metric").distinct()
    fitted = own.where(F.col("kind") != ALL).withColumn("borrowed", F.lit(False))
    thin = wanted.join(fitted.select("kind", "metric").distinct(), ["kind", "metric"], "left_anti")
    borrowed = thin.join(own.where(F.col("kind") == ALL).drop("kind"), "metric").withColumn("borrowed", F.lit(True))
    return fitted.unionByName(borrowed.select(fitted.columns))


def first_parts(rows: DataFrame) -> DataFrame:
    """Readings of posts, an album being its first part among these rows; the part's own counters stand for the album."""
    first = rows.where("album is not null").groupBy("channel_id", "album").agg(F.min("msg_id").alias("_first"))
    return rows.join(first, ["channel_id", "album"], "left").where("album is null or msg_id = _first").drop("_first")


def scored_readings(long: DataFrame, since: Column | None = None, now: Column | None = None) -> DataFrame:
    """The readings to score: of seeds, of posts published from ``since`` to ``now`` and read up to ``now``, albums once."""
    rows = long.where("seed")
    if since is not None:
        rows = rows.where(F.col("published_at") >= since)
    if now is not None:
        rows = rows.where((F.col("published_at") <= now) & (F.col("observed_at") <= now))
    return first_parts(rows)


def scores(long: DataFrame, baseline: DataFrame, medians: DataFrame, p: BaselineParams = BaselineParams(), since: Column | None = None, now: Column | None = None) -> DataFrame:
    """z and expected value of every reading that can be scored; a missing part of the baseline leaves it out.

    A zero reading counts as half. ``now`` hides what was published or read later, so a replay sees what a live pass saw.
    """
    rows = scored_readings(long, since, now).where(F.col("metric").isin(*p.alerting))
    rows = rows.join(baseline, ["kind", "metric", "band"]).join(medians.select("channel_id", "metric", "median"), ["channel_id", "metric"])
    expected = F.col("median") * F.col("factor") * F.col("fraction")
    z = F.ln(F.greatest(F.col("value"), F.lit(0.5)) / F.col("expected")) / F.col("spread")
    return rows.withColumn("expected", expected).where("expected > 0 and spread > 0").withColumn("z", z)


def metric_order() -> Column:
    return F.element_at(F.create_map(*[x for i, m in enumerate(METRICS) for x in (F.lit(m), F.lit(i))]), F.col("metric"))


def ranked(scored: DataFrame) -> DataFrame:
    """The scores of each reading, highest first: channel_id, msg_id, observed_at, metric, z, place; ties in the order of the metrics."""
    each = scored.groupBy("channel_id", "msg_id", "observed_at").agg(F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("z"), metric_order().alias("o"), "metric"))).alias("s"))  # a metric once each
    rows = each.select("channel_id", "msg_id", "observed_at", F.posexplode("s").alias("at", "s"))
    return rows.select("channel_id", "msg_id", "observed_at", "s.metric", (-F.col("s.z")).alias("z"), (F.col("at") + 1).alias("place"))


def spikes(scored: DataFrame, p: BaselineParams = BaselineParams()) -> DataFrame:
    """The best score of each post at or over the threshold: highest z, then metric order, then the youngest reading; highest first."""
    best = scored.groupBy("channel_id", "msg_id").agg(F.max(F.struct("z", (-metric_order()).alias("o"), (-F.col("age")).alias("a"), "metric", "value", "expected")).alias("s"))
    rows = best.select("channel_id", "msg_id", "s.metric", "s.z", "s.value", "s.expected", (-F.col("s.a")).alias("age"))
    return rows.where(F.col("z") >= p.threshold).withColumn("times", F.col("value") / F.col("expected")).orderBy(F.desc("z"), "channel_id", "msg_id")


def summary(long: DataFrame, scored: DataFrame, found: DataFrame, medians: DataFrame, scoped: DataFrame, p: BaselineParams = BaselineParams(), since: Column | None = None, now: Column | None = None) -> DataFrame:
    """One row: posts in the window, posts scored, posts over the threshold, channels in scope, channels with a median."""
    count = lambda df, name, *keys: df.select(*keys).distinct().agg(F.count("*").alias(name))
    parts = [
        count(scored_readings(long, since, now), "posts", "channel_id", "msg_id"), count(scored, "scored", "channel_id", "msg_id"), count(found.where(F.col("z") >= p.threshold), "crossed", "channel_id", "msg_id"),
        count(scoped.where("seed and healthy"), "channels_in_scope", "channel_id"), count(medians, "channels_with_baseline", "channel_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


@dataclass(frozen=True)
class StoredBaseline:
    """What a fit leaves for later passes; each row bears the number of its run."""

    runs: DataFrame
    medians: DataFrame
    curves: DataFrame


def stored(medians: DataFrame, baseline: DataFrame, run_id: int, completed_at: Column) -> StoredBaseline:
    """A run's header, channel medians and curves to append to their tables."""
    header = medians.agg(F.countDistinct("channel_id").alias("channels")).crossJoin(baseline.agg(F.count("*").alias("points")))
    run = F.lit(run_id).cast("bigint")
    return StoredBaseline(header.select(run.alias("id"), completed_at.alias("completed_at"), "channels", "points"), medians.withColumn("run_id", run), baseline.withColumn("run_id", run))


def load(kept: StoredBaseline, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Medians and curves of the newest completed run (at most one): what ``scores`` takes. Nothing completed gives empty tables."""
    newest = completed_run(kept.runs, as_of).select(F.col("id").alias("run_id"))
    return kept.medians.join(F.broadcast(newest), "run_id").drop("run_id"), kept.curves.join(F.broadcast(newest), "run_id").drop("run_id")
