"""Score components and receipts that add up to the cent."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, round_half_up
from .urls import bare_host

# Score method versions, weights and saturation points.
HIRING_VERSION = "2026-08-02"
EVIDENCE_VERSION = "2026-07-27"
GROWTH_WINDOW_DAYS = 90
VOLUME_SATURATION = 12
GROWTH_SATURATION = 6
DEFAULT_STAGE_WEIGHT = 0.7
STAGE_WEIGHTS = {
    "pre-seed": 0.5,
    "seed": 0.6,
    "early stage": 0.65,
    "series a": 0.8,
    "series b": 0.9,
    "series c": 0.95,
    "series d": 1.0,
    "series e": 1.0,
    "series f": 1.0,
    "series g": 1.0,
    "series h": 1.0,
    "growth": 1.0,
}


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / 86400000.0


def decay(days: Column, full: float, zero: float) -> Column:
    return (
        F.when(days <= full, F.lit(1.0)).when(days >= zero, F.lit(0.0))
        .otherwise((F.lit(zero) - days) / (zero - full))
    )


def volume_points(open_jobs: Column) -> Column:
    roles = F.greatest(open_jobs, F.lit(0))
    return F.lit(30.0) * F.least(F.lit(1.0), F.log1p(roles) / math.log1p(VOLUME_SATURATION))


def growth_points(opened: Column, closed: Column) -> Column:
    net = (opened - closed) / F.lit(float(GROWTH_SATURATION))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), net))
    return F.when(opened + closed == 0, F.lit(9.0)).otherwise(F.lit(15.0) * (1 + bounded))


def funding_points(stage: Column, funded_on: Column, now: Column) -> Column:
    pairs = [F.lit(v) for item in STAGE_WEIGHTS.items() for v in item]
    weight = F.coalesce(
        F.try_element_at(F.create_map(*pairs), F.lower(F.trim(stage))), F.lit(DEFAULT_STAGE_WEIGHT)
    )
    age = days_between(funded_on, now)
    recency = (
        F.when(age.isNull(), F.lit(0.6)).when(age <= 180, F.lit(1.0)).when(age >= 540, F.lit(0.4))
        .otherwise(1 - F.lit(0.6) * ((age - 180) / 360.0))
    )
    return F.lit(25.0) * weight * recency


def freshness_points(verified_at: Column, now: Column) -> Column:
    age = F.greatest(days_between(verified_at, now), F.lit(0.0))
    return F.coalesce(F.lit(15.0) * decay(age, 2.0, 30.0), F.lit(0.0))


def recency_points(verified_at: Column, now: Column) -> Column:
    age = days_between(verified_at, now)
    return F.when(age.isNull(), F.lit(0.0)).otherwise(
        F.lit(40.0) * decay(F.greatest(age, F.lit(0.0)), 2.0, 30.0)
    )


def coverage_points(board_verified: Column, open_jobs: Column, fresh: Column) -> Column:
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(fresh, open_jobs)))
    return (
        F.when(~F.coalesce(board_verified, F.lit(False)), F.lit(0.0))
        .when(open_jobs == 0, F.lit(30.0)).otherwise(F.lit(30.0) * ratio)
    )


def completeness_points(founded: Column, funded_on: Column, source_url: Column, careers_url: Column) -> Column:
    def five(present: Column) -> Column:
        return F.when(present, F.lit(5.0)).otherwise(F.lit(0.0))

    return (
        five(founded.isNotNull()) + five(funded_on.isNotNull())
        + five(F.coalesce(source_url, F.lit("")) != "") + five(F.coalesce(careers_url, F.lit("")) != "")
    )


def corroboration_points(source_url: Column, careers_url: Column) -> Column:
    left = F.coalesce(bare_host(source_url), F.lit(""))
    right = F.coalesce(bare_host(careers_url), F.lit(""))
    return F.when((left != "") & (right != "") & (left != right), F.lit(10.0)).otherwise(F.lit(0.0))


def receipt(version: str, names: list[str], points: list[Column], maxima: list[int]) -> Column:
    """struct(value, version, components) whose component points add up to the value.

    The total is rounded half up and the rounding residual is applied from the last component
    backwards, never beyond a component's own bounds.
    """
    def rounded(raw: Column) -> Column:
        total = F.aggregate(raw, F.lit(0.0), lambda a, p: a + p)
        return F.struct(
            round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).cast("long").alias("value"),
            F.transform(raw, lambda p: round_half_up(p * 100).cast("long")).alias("cents"),
        )

    def settled(r: Column) -> Column:
        rest = r["value"] * 100 - F.aggregate(r["cents"], F.lit(0).cast("long"), lambda a, c: a + c)
        bounds = F.array(*[F.lit(m * 100).cast("long") for m in maxima])
        start = F.struct(rest.alias("rest"), F.array().cast("array<bigint>").alias("cents"))

        def step(done: Column, item: Column) -> Column:
            room = F.when(done["rest"] > 0, item["1"] - item["0"]).otherwise(item["0"])
            applied = (F.signum(done["rest"]) * F.least(F.abs(done["rest"]), room)).cast("long")
            return let(applied, lambda a: F.struct(
                (done["rest"] - a).alias("rest"),
                F.concat(F.array(item["0"] + a), done["cents"]).alias("cents"),
            ))

        return F.aggregate(F.reverse(F.arrays_zip(r["cents"].alias("0"), bounds.alias("1"))), start, step)["cents"]

    def whole(r: Column) -> Column:
        labels = F.array(*[F.lit(n) for n in names])
        limits = F.array(*[F.lit(m) for m in maxima])
        parts = let(settled(r), lambda cents: F.transform(labels, lambda name, i: F.struct(
            name.alias("name"), (F.get(cents, i) / F.lit(100)).cast("decimal(6,2)").alias("points"),
            F.get(limits, i).alias("max"),
        )))
        return F.struct(r["value"].cast("int").alias("value"), F.lit(version).alias("version"), parts.alias("components"))

    raw = F.array(*[p.cast("double") for p in points])
    return let(raw, lambda p: let(rounded(p), whole))
