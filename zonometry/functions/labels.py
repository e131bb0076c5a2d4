"""Text labels: place case, provider classes, severity bands, profiles, driver sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonometry.functions.keys import contains_any

# Provider-taxonomy names the class rules test.
PRIMARY_CARE = ["Family Medicine", "Internal Medicine", "Pediatrics", "General Practice", "Geriatric Medicine"]
BEHAVIORAL_GROUPING = "Behavioral Health & Social Service Providers"
PSYCHIATRY_CLASS = "Psychiatry & Neurology"
PHYSICIAN_GROUPING = "Allopathic & Osteopathic Physicians"
DENTAL_GROUPING = "Dental Providers"
MATERNITY_CLASS = "Obstetrics & Gynecology"
# Fixed values: (threshold, label) of the severity words.
SEVERITY = [(80, "Highest"), (60, "High"), (40, "Moderate"), (20, "Low")]
# Band cuts, the gap that makes a profile lean, the share gap that names a driver.
BAND_HIGH, BAND_LOW, PROFILE_GAP, DRIVER_GAP = 66, 33, 15, 0.1
# Keyword probes behind each facility flag.
FACILITY_FLAGS = {
    "mat": ["buprenorphine", "methadone", "naltrexone", "vivitrol", "medication assisted", "medications for"],
    "accepts_medicaid": ["medicaid"],
    "sliding_scale": ["sliding fee", "sliding scale", "payment assistance"],
    "accepts_uninsured": ["no payment", "free", "self-payment", "cash or self"],
}


def title_case(c: Column) -> Column:
    """Every run of letters starts upper, the rest lower (``O'FALLON`` -> ``O'Fallon``).

    A mark before each run lets one split isolate the runs; plain initcap only breaks at spaces.
    """
    marked = F.regexp_replace(F.trim(c), r"(\p{L}+)", "\u0001$1")
    pieces = F.split(marked, "\u0001")
    cased = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
    return F.when(F.trim(c) != "", F.array_join(cased, ""))


def provider_class(grouping: Column, classification: Column, specialization: Column) -> Column:
    """First matching rule wins."""
    g, c, s = F.trim(grouping), F.trim(classification), F.lower(F.trim(specialization))
    mid_level = c.isin("Nurse Practitioner", "Physician Assistant")
    return (
        F.when((g == DENTAL_GROUPING) & (c == "Dentist"), "dental")
        .when(g == BEHAVIORAL_GROUPING, "mental_health")
        .when((c == PSYCHIATRY_CLASS) & s.contains("psychiatry"), "mental_health")
        .when(c == MATERNITY_CLASS, "obgyn")
        .when((g == PHYSICIAN_GROUPING) & c.isin(PRIMARY_CARE), "primary_care")
        .when(mid_level & contains_any(s, ["psychiatr", "mental health", "behavioral"]), "mental_health")
        .when(mid_level, "primary_care")
        .when(g == PHYSICIAN_GROUPING, "specialist")
        .otherwise("other")
    )


def facility_flags(blob: Column) -> dict[str, Column]:
    return {name: contains_any(blob, words) for name, words in FACILITY_FLAGS.items()}


def severity(p: Column) -> Column:
    chain = F.when(p.isNull(), F.lit(None).cast("string"))
    for cut, word in SEVERITY:
        chain = chain.when(p >= cut, word)
    return chain.otherwise("Lowest")


def band(p: Column) -> Column:
    return (
        F.when(p.isNull(), "unknown").when(p >= BAND_HIGH, "high").when(p <= BAND_LOW, "low").otherwise("moderate")
    )


def ordinal(p: Column) -> Column:
    """``21st`` style text of a rounded percentile."""
    n = F.round(p).cast("long")
    ten, hundred = n % 10, n % 100
    suffix = (
        F.when(hundred.between(11, 13), "th").when(ten == 1, "st").when(ten == 2, "nd").when(ten == 3, "rd")
        .otherwise("th")
    )
    return F.when(p.isNotNull(), F.concat(n.cast("string"), suffix))


def profile_kind(need: list[tuple[Column, float]], access: Column) -> Column:
    """need-driven / access-driven / both, from the weighted need side against access."""
    present = [F.when(v.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in need]
    count = sum(F.when(v.isNotNull(), 1).otherwise(0) for v, _ in need)
    wsum = sum(present)
    weighted = sum(F.coalesce(v, F.lit(0.0)) * w for v, w in need)
    plain = sum(F.coalesce(v, F.lit(0.0)) for v, _ in need)
    need_mean = F.when(wsum > 0, weighted / wsum).otherwise(F.when(count > 0, plain / count))
    gap = need_mean - access
    return F.when(access.isNotNull() & (count > 0),
                  F.when(gap >= PROFILE_GAP, "need-driven").when(gap <= -PROFILE_GAP, "access-driven")
                  .otherwise("both"))


def driver_tail(parts: list[tuple[str, Column]]) -> Column:
    """Which contributions lead. ``parts`` are (label, contribution); null when none is known."""
    ranked = F.array_sort(F.array(*[
        F.struct((-c).alias("neg"), F.lit(i).alias("pos"), F.lit(label).alias("label"))
        for i, (label, c) in enumerate(parts)
    ]))
    total = sum(c for _, c in parts)
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    share = [-ranked[i]["neg"] / total for i in range(3)]
    first, second = ranked[0]["label"], ranked[1]["label"]
    return (
        F.when(total.isNull(), "driven by several factors together")
        .when(share[0] - share[1] >= DRIVER_GAP, F.concat(F.lit("driven mostly by "), first))
        .when(share[0] - share[2] < DRIVER_GAP, "driven roughly equally across the dimensions")
        .otherwise(F.concat(F.lit("driven mainly by "), first, F.lit(" and "), second))
    )


def sentence(need: Column, vulnerability: Column, access: Column, tail: Column) -> Column:
    return F.concat(
        F.initcap(band(need)), F.lit(" health need, "), band(vulnerability), F.lit(" social vulnerability, and "),
        band(access), F.lit(" barriers to care. The access disadvantage here is "), tail, F.lit("."),
    )
