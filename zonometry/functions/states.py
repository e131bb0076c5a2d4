"""State lookups: three-digit prefix ranges and two-digit codes, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonometry.functions.keys import in_prefix_ranges

# Postal prefix ranges (state, first, last prefix), both ends included; the first range wins.
PREFIX_RANGES = [
    ("MA", 10, 27), ("MA", 55, 55), ("RI", 28, 29), ("NH", 30, 38), ("ME", 39, 49),
    ("VT", 50, 54), ("VT", 56, 59), ("CT", 60, 69), ("NJ", 70, 89), ("NY", 0, 0),
    ("NY", 5, 5), ("NY", 100, 149), ("PR", 6, 9), ("PA", 150, 196), ("DE", 197, 199),
    ("DC", 200, 205), ("DC", 569, 569), ("MD", 206, 219), ("VA", 220, 246), ("WV", 247, 268),
    ("NC", 270, 289), ("SC", 290, 299), ("GA", 300, 319), ("GA", 398, 399), ("FL", 320, 349),
    ("AL", 350, 369), ("TN", 370, 385), ("MS", 386, 397), ("KY", 400, 427), ("OH", 430, 459),
    ("IN", 460, 479), ("MI", 480, 499), ("IA", 500, 528), ("WI", 530, 549), ("MN", 550, 567),
    ("SD", 570, 577), ("ND", 580, 588), ("MT", 590, 599), ("IL", 600, 629), ("MO", 630, 658),
    ("KS", 660, 679), ("NE", 680, 693), ("LA", 700, 714), ("AR", 716, 729), ("AR", 755, 755),
    ("OK", 730, 749), ("TX", 750, 799), ("TX", 885, 885), ("CO", 800, 816), ("WY", 820, 831),
    ("ID", 832, 838), ("UT", 840, 847), ("AZ", 850, 865), ("NM", 870, 884), ("NV", 889, 898),
    ("CA", 900, 961), ("HI", 967, 968), ("OR", 970, 979), ("WA", 980, 994), ("AK", 995, 999),
]
# Two-digit state code, postal abbreviation, name.
STATE_CODES = [
    ("01", "AL", "Alabama"), ("02", "AK", "Alaska"), ("04", "AZ", "Arizona"),
    ("05", "AR", "Arkansas"), ("06", "CA", "California"), ("08", "CO", "Colorado"),
    ("09", "CT", "Connecticut"), ("10", "DE", "Delaware"), ("11", "DC", "District of Columbia"),
    ("12", "FL", "Florida"), ("13", "GA", "Georgia"), ("15", "HI", "Hawaii"),
    ("16", "ID", "Idaho"), ("17", "IL", "Illinois"), ("18", "IN", "Indiana"),
    ("19", "IA", "Iowa"), ("20", "KS", "Kansas"), ("21", "KY", "Kentucky"),
    ("22", "LA", "Louisiana"), ("23", "ME", "Maine"), ("24", "MD", "Maryland"),
    ("25", "MA", "Massachusetts"), ("26", "MI", "Michigan"), ("27", "MN", "Minnesota"),
    ("28", "MS", "Mississippi"), ("29", "MO", "Missouri"), ("30", "MT", "Montana"),
    ("31", "NE", "Nebraska"), ("32", "NV", "Nevada"), ("33", "NH", "New Hampshire"),
    ("34", "NJ", "New Jersey"), ("35", "NM", "New Mexico"), ("36", "NY", "New York"),
    ("37", "NC", "North Carolina"), ("38", "ND", "North Dakota"), ("39", "OH", "Ohio"),
    ("40", "OK", "Oklahoma"), ("41", "OR", "Oregon"), ("42", "PA", "Pennsylvania"),
    ("44", "RI", "Rhode Island"), ("45", "SC", "South Carolina"), ("46", "SD", "South Dakota"),
    ("47", "TN", "Tennessee"), ("48", "TX", "Texas"), ("49", "UT", "Utah"),
    ("50", "VT", "Vermont"), ("51", "VA", "Virginia"), ("53", "WA", "Washington"),
    ("54", "WV", "West Virginia"), ("55", "WI", "Wisconsin"), ("56", "WY", "Wyoming"),
    ("72", "PR", "Puerto Rico"),
]
# Prefix ranges of the regional slices.
REGION_RANGES = {
    "CA": [(900, 961)],
    "NY": [(100, 149)],
    "TX": [(750, 799), (885, 885)],
    "FL": [(320, 349)],
    "WA": [(980, 994)],
}


def prefix_table(spark: SparkSession) -> DataFrame:
    """(prefix int, state): ranges expanded to at most 1,000 equi-join rows, first range wins."""
    rows = [(*r, i) for i, r in enumerate(PREFIX_RANGES)]
    ranges = spark.createDataFrame(rows, "state string, lo int, hi int, ord int")
    each = ranges.select("state", "ord", F.explode(F.sequence("lo", "hi")).alias("prefix"))
    return each.groupBy("prefix").agg(F.min_by("state", "ord").alias("prefix_state"))


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_CODES, "fips_code string, fips_state string, state_name string")


def prefix_of(key: Column) -> Column:
    """Numeric three-digit prefix, null unless all three are digits."""
    p3 = F.substring(key, 1, 3)
    return F.when(p3.rlike("^[0-9]{3}$"), p3.cast("int"))


def with_prefix_state(df: DataFrame, key: str, out: str = "prefix_state") -> DataFrame:
    """Range lookup as an equi-join on the expanded table (1,000 rows, so Spark broadcasts it)."""
    table = prefix_table(df.sparkSession).withColumnRenamed("prefix", "__prefix")
    joined = df.withColumn("__prefix", prefix_of(F.col(key))).join(table, "__prefix", "left").drop("__prefix")
    return joined.withColumnRenamed("prefix_state", out)


def with_fips_state(df: DataFrame, fips: str) -> DataFrame:
    """State abbreviation and name from the first two digits of a county code."""
    table = code_table(df.sparkSession).withColumnRenamed("fips_code", "__code")
    return df.withColumn("__code", F.substring(F.col(fips), 1, 2)).join(table, "__code", "left").drop("__code")


def with_state(df: DataFrame, key: str, fips: str) -> DataFrame:
    """Exact code beats the prefix guess; the name follows the winner."""
    names = code_table(df.sparkSession).select(F.col("fips_state").alias("state"), "state_name")
    both = with_fips_state(with_prefix_state(df, key), fips).drop("state_name")
    both = both.withColumn("state", F.coalesce("fips_state", "prefix_state"))
    return both.join(names, "state", "left")


def in_region(key: Column, region: str | None) -> Column:
    """True for keys of a regional slice; an unknown region, or none, takes in everything."""
    ranges = REGION_RANGES.get((region or "").upper())
    return in_prefix_ranges(key, ranges) if ranges else F.lit(True)
