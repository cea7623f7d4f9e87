"""Which states each market area lies in, from a table of counties: unpivoted area columns, areas made of other areas,
and areas at sea. What searches take as area_states and county_prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes

#: Area columns of the county table, and the prefixes of the market codes that a number in each names, the number in three
#: digits; 700-MHz groups are numbered from 700 (fixed values).
AREA_COLUMNS = {"CMA": ("CMA", "IVM"), "EA": ("BEA",), "MEA": ("MEA",), "MTA": ("MTA",), "BTA": ("BTA",), "REA": ("REA",), "EAG_220": ("EAG",), "EAG_700": ("EAG",), "RPC": ("RPC",), "VPC": ("VPC",)}
NUMBERED_FROM = {"EAG_700": 700}
#: The economic areas that maritime areas 1 to 10 are made of, by 47 CFR 80.385(a)(3) (fixed values).
MARITIME_AREAS = (
    "1-5, 10",
    "9, 11-23, 25, 42, 46",
    "24, 26-34, 37, 38, 40, 41, 174",
    "35, 36, 39, 43-45, 47-53, 67-107, 113, 116-120, 122-125, 127, 130-134, 176",
    "6-8, 54-66, 108, 109",
    "160-165",
    "147, 166-170",
    "172",
    "171",
    "110-112, 114-115, 121, 126, 128, 129, 135-146, 148-159",
)
#: Trading areas at sea, which no county names, and how county tables spell two names (fixed values).
SEA_AREAS = ("BTA494", "BTA495")
AT_SEA, SAMOA = "Gulf of Mexico", "American Samoas"
SEA_CODE = "GM"


def _numbers(spec: str) -> list[int]:
    """The numbers of a list such as `1-5, 10`."""
    ends = [part.strip().split("-") for part in spec.split(",")]
    return [n for e in ends for n in range(int(e[0]), int(e[-1]) + 1)]


def maritime_parts() -> list[tuple[str, int]]:
    """(market code, economic area) of every maritime area."""
    return [(f"AMT{i:03d}", n) for i, spec in enumerate(MARITIME_AREAS, 1) for n in _numbers(spec)]


def state_of_name(name: Column) -> Column:
    """The USPS code of a state's name as county tables spell it; null for the sea and for names that are no state's."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[.,]", ""), r"\s+", " ")
    known = F.create_map(*[F.lit(x) for pair in codes.state_codes().items() for x in pair])
    return F.when(F.trim(name) == SAMOA, F.lit("AS")).otherwise(F.try_element_at(known, key))


def area_numbers(counties: DataFrame) -> DataFrame:
    """state, area column and number of every area that a county lies in: the area columns as rows, blanks and 0 left out."""
    number = lambda c: F.coalesce(F.trim(F.col(c).cast("string")).try_cast("int"), F.lit(0))
    wide = counties.select(state_of_name(F.col("STATE")).alias("state"), *[number(c).alias(c) for c in AREA_COLUMNS])
    return wide.unpivot("state", list(AREA_COLUMNS), "area", "number").where("number <> 0")


def county_problems(counties: DataFrame) -> DataFrame:
    """problem and what: states that aren't known, prefixes of two states, and maritime parts that no county lies in."""
    state, prefix = state_of_name(F.col("STATE")), F.substring("FIPS", 1, 2)
    unknown = counties.where(state.isNull() & (F.coalesce(F.trim("STATE"), F.lit("")) != AT_SEA)).select(F.lit("unknown state").alias("problem"), F.coalesce("STATE", F.lit("")).alias("what"))
    twice = counties.select(prefix.alias("what"), state.alias("s")).groupBy("what").agg(F.count_distinct("s").alias("n")).where("n > 1").select(F.lit("prefix of two states").alias("problem"), "what")
    there = area_numbers(counties).where("area = 'EA'").select(F.col("number").alias("ea")).distinct()
    parts = counties.sparkSession.createDataFrame(maritime_parts(), "code string, ea int")
    missing = parts.join(there, "ea", "left_anti").select(F.lit("maritime part of no county").alias("problem"), F.concat_ws(" ", "code", F.col("ea").cast("string")).alias("what"))
    return unknown.distinct().unionByName(twice).unionByName(missing)


def county_prefixes(counties: DataFrame) -> DataFrame:
    """county_prefix and state: the first two digits of county numbers. Of a prefix of two states, the first by name."""
    own = counties.select(F.substring("FIPS", 1, 2).alias("county_prefix"), state_of_name(F.col("STATE")).alias("state"))
    return own.where("state IS NOT NULL").groupBy("county_prefix").agg(F.min("state").alias("state"))


def area_states(counties: DataFrame, partial_areas: DataFrame | None = None) -> DataFrame:
    """market_code and state of every market area, a row for each state; an area in no state has one row, of a null state.

    counties: STATE (a name), FIPS and the columns of AREA_COLUMNS, as text or numbers; partial_areas: number and state
    (a code, GM at sea) of the counties of partial economic areas. Areas at sea, maritime areas (made of economic areas)
    and the states' own areas (in the order of their codes, Palau counted) follow from them. Counties of unknown states
    and partial areas of unknown codes add an area without a state: look at county_problems first. Each area is grouped
    with partial aggregation, so an area with most counties is no hot task.
    """
    spark, numbers = counties.sparkSession, area_numbers(counties)
    prefixes = spark.createDataFrame([(c, p, NUMBERED_FROM.get(c, 0)) for c, own in AREA_COLUMNS.items() for p in own], "area string, prefix string, first int")
    named = numbers.join(F.broadcast(prefixes), "area").select(F.concat("prefix", F.lpad((F.col("number") + F.col("first")).cast("string"), 3, "0")).alias("market_code"), "state")
    parts = spark.createDataFrame(maritime_parts(), "market_code string, number int")
    maritime = F.broadcast(parts).join(numbers.where("area = 'EA'"), "number").select("market_code", "state")
    sea = spark.createDataFrame([(c, None) for c in SEA_AREAS], "market_code string, state string")
    states = [(f"SLC{i:03d}", s) for i, s in enumerate(sorted({*codes.USPS_STATES, "PW"}), 1) if s != "PW"]
    every = named.unionByName(maritime).unionByName(sea).unionByName(spark.createDataFrame(states, "market_code string, state string"))
    if partial_areas is not None:
        known = F.when(F.col("state").isin(*codes.USPS_STATES), F.col("state"))
        every = every.unionByName(partial_areas.select(F.concat(F.lit("PEA"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("market_code"), known.alias("state")))
    grouped = every.groupBy("market_code").agg(F.collect_set("state").alias("states"))
    return grouped.select("market_code", F.explode_outer("states").alias("state"))
