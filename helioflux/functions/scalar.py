"""Scalar functions as column expressions: everything here stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def lookup(table: dict[str, float | str], key: Column, kind: str = "double") -> Column:
    """A small fixed table as a CASE expression; null where the key is missing."""
    out = F.lit(None).cast(kind)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v).cast(kind)).otherwise(out)
    return out


# --- classes of a peak flux -------------------------------------------------------------------------------------------
def class_letter(f: Column) -> Column:
    """Letter of the decade: A below 1e-7 (all fluxes under 1e-8 too), X from 1e-4 on."""
    e = F.floor(F.log10(f))
    return F.when(f <= 0, "A").when(e >= -4, "X").when(e == -5, "M").when(e == -6, "C").when(e == -7, "B").otherwise("A")


def class_mantissa(f: Column) -> Column:
    """Flux in units of its class floor; 0 for fluxes that are not positive."""
    e = F.floor(F.log10(f))
    return F.when(f <= 0, 0.0).when(e >= -4, f / 1e-4).when(e <= -8, f / 1e-8).otherwise(f / F.pow(F.lit(10.0), e))


def classify_flux(f: Column) -> Column:
    """Class string such as M2.5; the mantissa is rounded half to even after the decade is chosen, so C10.0 can occur."""
    return F.concat(class_letter(f), F.replace(F.format_number(class_mantissa(f), 1), F.lit(","), F.lit("")))


def class_floor(letter: Column) -> Column:
    return lookup(K.CLASS_FLOORS, F.upper(letter))


def class_to_flux(c: Column) -> Column:
    """Flux of a class string; a missing mantissa is 1. Null for unknown letters and mantissas that are no number."""
    rest = F.trim(F.substring(c, 2, 30))
    return F.when(rest == "", 1.0).otherwise(rest.try_cast("double")) * class_floor(F.substring(c, 1, 1))


def goes_class(f: Column, below: str = "Q") -> Column:
    """Class string by thresholds, with ``below`` under the A floor (ingest says Q, the generator A<0.1)."""
    out = F.lit(below)
    for letter, floor in K.CLASS_FLOORS.items():
        out = F.when(f >= floor, F.concat(F.lit(letter), F.replace(F.format_number(f / floor, 1), F.lit(","), F.lit("")))).otherwise(out)
    return out


def class_rank(c: Column) -> Column:
    """Letter index plus a tenth of the mantissa (1 where it is missing); -1 for anything else."""
    at = F.instr(F.lit(K.LADDER), F.upper(F.substring(c, 1, 1))) - 1
    rest = F.substring(c, 2, 30)
    m = F.when(rest == "", 1.0).otherwise(rest.try_cast("double"))
    return F.when((F.length(c) > 0) & (at >= 0) & m.isNotNull(), at + m / 10).otherwise(-1.0)


def class_at_least(c: Column, threshold: str) -> Column:
    """Letter first, then mantissa; a bare threshold letter has mantissa 0. Anything that is no class counts as A1.0."""
    c = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    at = F.instr(F.lit(K.LADDER), F.substring(c, 1, 1)) - 1
    known = (F.length(c) > 0) & (at >= 0)
    at = F.when(known, at).otherwise(0)
    m = F.when(known, F.coalesce(F.trim(F.substring(c, 2, 30)).try_cast("double"), F.lit(1.0))).otherwise(1.0)
    need, need_m = K.LADDER.index(threshold[0].upper()), float(threshold[1:] or 0)
    return (at > need) | ((at == need) & (m >= need_m))


def sdd_arbitration(sdd1: Column, sdd2: Column, ceiling: float = K.SATURATION_CPS) -> Column:
    """Struct: the detector to read (the first unless it is saturated), its value, and which are saturated."""
    over1, over2 = sdd1 >= ceiling, sdd2 >= ceiling
    return F.struct(
        F.when(over1, "SDD2").otherwise("SDD1").alias("detector_used"),
        F.when(over1, sdd2).otherwise(sdd1).alias("value"),
        over1.alias("saturated"),
        (over1 & over2).alias("both_saturated"),
    )


# --- time and units ---------------------------------------------------------------------------------------------------
def ltt_delta(r_au: Column | float, ref_au: float = 1.0) -> Column:
    """Seconds by which light reaches the reference distance later than the vantage point."""
    return (F.lit(ref_au) - r_au) * K.AU_KM / K.C_KM_S


def platform_radius(name: Column) -> Column:
    """Distance of a named platform; white space and case do not matter. Unknown names raise an error at run time."""
    key = F.upper(F.regexp_replace(F.trim(name), r"\s+", " "))
    r = lookup(K.PLATFORM_R_AU, key)
    return F.when(r.isNull(), F.raise_error(F.concat(F.lit("unknown platform "), name)).cast("double")).otherwise(r)


def earth_time(t: Column, r_au: Column, quantity: Column) -> Column:
    """Observation time moved to Earth; protons do not travel at light speed and keep theirs."""
    return F.when(quantity == "PROTON", t).otherwise(t + ltt_delta(r_au))


def canonical_unit(quantity: Column) -> Column:
    return F.coalesce(lookup(K.CANONICAL_UNITS, quantity, "string"), F.lit("1"))


def to_canonical(value: Column, unit: Column, quantity: Column) -> Column:
    """Value in the canonical unit; units that are not known aliases leave it unchanged."""
    norm = F.lower(F.regexp_replace(F.trim(unit), r"\s+", " "))
    factor = F.lit(None).cast("double")
    for q, table in K.UNIT_FACTORS.items():
        factor = F.when(quantity == q, lookup(table, norm)).otherwise(factor)
    return value * F.coalesce(factor, F.lit(1.0))


def transfer(x: Column, a: Column | float, b: Column | float, resid: Column | float) -> tuple[Column, Column]:
    """10 ** (a + b log10 x), and its sigma from the residual in dex."""
    y = F.pow(F.lit(10.0), F.lit(a) + F.lit(b) * F.log10(F.greatest(x, F.lit(1e-300))))
    return y, F.lit(math.log(10.0)) * y * resid


def solexs_to_goes(x: Column, hardness: Column | None = None) -> tuple[Column, Column]:
    a = F.lit(0.0) if hardness is None else F.lit(0.0) - F.lit(0.05) * (hardness - 1.0)
    return transfer(x, a, 1.0, 0.06)


def hxr_to_reference(x: Column, instrument: Column) -> tuple[Column, Column]:
    """Counts on the reference scale; unknown instruments pass with a residual of 0.15 dex."""
    key = F.upper(F.trim(instrument))
    part = lambda i, other: F.coalesce(lookup({k: v[i] for k, v in K.HXR_COEFFS.items()}, key), F.lit(other))
    return transfer(x, part(0, 0.0), part(1, 1.0), part(2, 0.15))


# --- quality ------------------------------------------------------------------------------------------------------------
def qc_bitmask(tokens: Column) -> Column:
    """Bits of an array of flag tokens, case ignored; unknown tokens add nothing."""
    bit = lambda x: F.coalesce(lookup({k: K.QC_BITS[v] for k, v in K.QC_TOKENS.items()}, F.lower(F.trim(x)), "int"), F.lit(0))
    return F.aggregate(tokens, F.lit(0), lambda a, x: a.bitwiseOR(bit(x)))


def housekeeping_gate(value: Column, saa: Column, eclipse: Column, off_point: Column, attenuator: Column, ceiling: float = K.SATURATION_CPS) -> tuple[Column, Column]:
    """Flag and bits of a sample from the state of its platform."""
    b = K.QC_BITS
    bad, over = saa | eclipse | off_point | attenuator, value >= ceiling
    bits = F.when(saa, b["NEAR_SAA"]).otherwise(0) + F.when(over, b["SATURATED"]).otherwise(0) + F.when(bad, b["BAD"]).when(over, b["SUSPECT"]).otherwise(b["GOOD"])
    return F.when(bad, "BAD").when(over, "SUSPECT").otherwise("GOOD"), bits


def spectral_shape_ok(spectrum: Column, response: Column, min_corr: float = 0.3, max_share: float = 0.8) -> Column:
    """Whether a spectrum is no single spike and follows the response (Pearson)."""
    n = F.size(spectrum).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    pos = F.transform(spectrum, lambda x: F.greatest(x, F.lit(0.0)))
    ma, mb = total(spectrum) / n, total(response) / n
    cov = total(F.zip_with(spectrum, response, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(spectrum, lambda x: (x - ma) * (x - ma))), total(F.transform(response, lambda y: (y - mb) * (y - mb)))
    corr = F.when(va * vb > 0, cov / F.sqrt(va * vb)).otherwise(0.0)
    return (total(pos) > 0) & (F.array_max(pos) / total(pos) <= max_share) & (corr >= min_corr)


# --- scores -----------------------------------------------------------------------------------------------------------
def noisy_or(probs: Column, clamp: bool = True) -> Column:
    """1 - product of (1 - p), each p clamped to [0, 1] or, without ``clamp``, taken as it is; 0 for an empty array."""
    own = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) if clamp else p
    return F.lit(1.0) - F.aggregate(probs, F.lit(1.0), lambda a, p: a * (F.lit(1.0) - own(p)))


def fuse_confidence(probs: Column, both_bands: Column, neupert: Column, bonus: float = 0.5, clamp: bool = True) -> Column:
    extra = lambda c: F.when(c, F.array(F.lit(bonus))).otherwise(F.array().cast("array<double>"))
    return noisy_or(F.concat(probs, extra(both_bands), extra(neupert)), clamp)


def match_score(soft_onset: Column, hard_onset: Column, soft_peak: Column, hard_peak: Column, lead: float = K.LEAD_S, lag: float = K.LAG_S) -> Column:
    """Proximity of onsets (0.7, window ``lead`` where hard comes first, else ``lag``) and order of peaks (0.3)."""
    d = soft_onset - hard_onset
    near = F.greatest(F.lit(0.0), F.lit(1.0) - F.when(d >= 0, d / lead).otherwise(-d / lag))
    order = F.when(hard_peak < soft_peak, 1.0).otherwise(0.0)
    return F.when(d.isNull(), 0.0).otherwise(F.lit(0.7) * near + F.lit(0.3) * order)


def poisson_llr(total: Column, n: Column, mu0: Column) -> Column:
    """Log-likelihood ratio of a raised rate over n bins against mu0; 0 where the mean is not raised."""
    return F.when((n > 0) & (total > n * mu0) & (mu0 > 0), total * F.ln(total / (n * mu0)) - (total - n * mu0)).otherwise(0.0)


def huber_weight(t: Column, c: float = 1.345) -> Column:
    return F.when(F.abs(t) <= c, 1.0).otherwise(F.lit(c) / F.abs(t))


# --- geometry -----------------------------------------------------------------------------------------------------------
def angular_separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in degrees."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)))))


def wrap180(a: Column) -> Column:
    w = F.pmod(a + 180.0, F.lit(360.0)) - 180.0
    return F.when(w == -180.0, 180.0).otherwise(w)


def far_side(sub_earth: Column, source: Column, margin: float = 90.0) -> Column:
    return F.abs(wrap180(source - sub_earth)) > margin


def annulus(dt: Column, baseline: Column, sigma_dt: Column) -> tuple[Column, Column]:
    """Radius and half-width in degrees of the triangulation ring of two arrival times."""
    theta = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.lit(K.C_KM_S) * dt / baseline)))
    s = F.sin(theta)
    return F.degrees(theta), F.when(s < 1e-6, 90.0).otherwise(F.degrees(F.lit(K.C_KM_S) * sigma_dt / (baseline * s)))


# --- the rest -----------------------------------------------------------------------------------------------------------
def bucket_of(t: Column, width: float = K.BUCKET_S) -> Column:
    return F.floor(t / width)


def epoch_ms(t: Column) -> Column:
    return F.rint(t * 1000).cast("long")


def safe_log10(x: Column, floor: float = K.FLUX_FLOOR) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))


def decayed_reliability(r: Column, times: Column, factor: float = 0.9, floor: float = 0.05) -> Column:
    """Reliability after ``times`` failures in a row."""
    return F.greatest(F.lit(floor), r * F.pow(F.lit(factor), times))


def restored_reliability(r: Column, times: Column, rate: float = 0.05, ceiling: float = 1.0) -> Column:
    return F.lit(ceiling) - (F.lit(ceiling) - r) * F.pow(F.lit(1.0 - rate), times)


def cycle_phase(t: Column) -> Column:
    return F.pmod((t - K.CYCLE_REF_S) / K.CYCLE_S, F.lit(1.0))


def paralyzable(n: Column, dead_time: float) -> Column:
    return n * F.exp(-n * dead_time)


def flux_to_counts(flux: Column) -> Column:
    """Counts a second of the soft detector at a flux, by a line through (1e-6, 1e3) and (1e-4, 10 ** 5.3) in decades; 0 without flux."""
    return F.when(flux > 0, F.pow(F.lit(10.0), F.lit(9.9) + F.lit(1.15) * F.log10(flux))).otherwise(0.0)


def focal_loss(logit: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    pt = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    a = F.when(y == 1, alpha).otherwise(1.0 - alpha)
    return -a * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * F.ln(F.greatest(pt, F.lit(1e-12)))


def hms(t: Column) -> Column:
    """Hours:minutes:seconds of a duration, rounded half to even; hours go on past 24."""
    s = F.abs(F.rint(t)).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    clock = F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))
    return F.when(t.isNull(), "   --   ").otherwise(F.concat(F.when(F.rint(t) < 0, "-").otherwise(""), clock))


def kv_key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def rounded(c: Column | str, places: int) -> Column:
    """``round``, the same number, for columns of which there are very many: decimals are made only near ties and for large numbers.

    Elsewhere the nearest integer is beyond doubt, and its quotient by a power of ten is the double nearest to the decimal.
    """
    x = F.col(c) if isinstance(c, str) else c
    up = x * F.lit(10.0**places)
    sure = (F.abs(x) < 1e6) & (F.abs(up - F.floor(up) - 0.5) > 0.01)  # not a number is not below
    return F.when(sure, F.floor(up + 0.5) / F.lit(10.0**places)).otherwise(F.round(x, places))
