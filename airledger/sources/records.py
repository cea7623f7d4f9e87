"""Pipe-delimited licence records: lines, layouts, typed decoding and counts of what was rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

MAX_LINE, MOST_FILES = 16_384, 512


@dataclass(frozen=True)
class Layout:
    """A record type: how many fields it has, which are decoded (position, name, kind), and which must be there."""

    type: str
    fields: int
    decoded: str
    required: tuple[str, ...]

    def columns(self) -> list[tuple[int, str, str]]:
        """(position, name, kind) of each decoded field."""
        return [(int(p), n, k) for p, n, k in (x.split(":") for x in self.decoded.split())]


#: Field counts, positions and names of record types (fixed values). Kinds: l number as long, d number, t text, D date,
#: u upper-case text, b flag, o long that may be blank but not malformed.
LAYOUTS = {
    x.type: x
    for x in (
        Layout("HD", 59, "2:usi:l 5:callsign:t 6:license_status:u 7:radio_service_code:t 8:grant_date:D 9:expired_date:D 10:cancellation_date:D 43:effective_date:D 44:last_action_date:D", ("usi",)),
        Layout("EN", 30, "2:usi:l 6:entity_type:t 8:entity_name:t 9:part_1:t 10:part_2:t 11:part_3:t 12:part_4:t 17:city:t 18:state:t 23:frn:t 24:applicant_type:t", ("usi",)),
        Layout("AM", 18, "2:usi:l 6:operator_class:t 9:trustee_callsign:t 16:previous_callsign:t 18:trustee_name:t", ("usi",)),
        Layout("LL", 7, "2:lease_usi:l 5:parent_callsign:t 6:lease_id:t 7:parent_usi:l", ("lease_usi", "parent_usi")),
        Layout("LO", 51, "2:usi:l 7:location_type:t 8:location_class:t 9:location_number:l 12:address:t 13:city:t 14:county:t 15:state:t 16:radius_km:d 19:ground_elevation_m:d 20:lat_d:t 21:lat_m:t 22:lat_s:t 23:lat_h:t 24:lon_d:t 25:lon_m:t 26:lon_s:t 27:lon_h:t 38:asr_number:t 39:support_height_m:d 40:overall_height_m:d 41:structure_type:t 43:location_name:t", ("usi", "location_number")),
        Layout("AN", 38, "2:usi:l 7:antenna_number:o 8:location_number:l 10:antenna_type:t 11:height_to_tip_m:d 12:height_to_center_m:d 13:make:t 14:model:t 16:polarization:t 17:beamwidth_deg:d 18:gain_dbi:d 19:azimuth_deg:d 20:haat_m:d", ("usi", "location_number")),
        Layout("FR", 30, "2:usi:l 7:location_number:l 8:antenna_number:l 9:class_station:t 11:frequency_mhz:d 12:upper_mhz:d 16:power_output_w:d 17:erp_w:d 21:eirp_dbm:d 22:transmitter_make:t 23:transmitter_model:t 27:freq_seq_id:l", ("usi", "location_number", "antenna_number", "freq_seq_id")),
        Layout("EM", 16, "2:usi:l 6:location_number:l 7:antenna_number:l 8:frequency_mhz:d 10:emission_code:t 13:freq_seq_id:l", ("usi", "location_number", "antenna_number", "emission_code", "freq_seq_id")),
        Layout("MK", 23, "2:usi:l 6:market_code:t 7:channel_block:t 9:market_name:t", ("usi",)),
        Layout("MF", 10, "2:usi:l 6:partition_area_id:l 7:lower:d 8:upper:d", ("usi", "lower")),
        Layout("PA", 24, "2:usi:l 7:path_number:l 8:location_number:l 9:antenna_number:l 10:receive_location_number:l 11:receive_antenna_number:o 13:path_type:t 14:passive_receiver:b 17:receiver_callsign:t", ("usi", "path_number", "location_number", "antenna_number", "receive_location_number")),
    )
}

#: What makes a value of a trimmed field.
_KINDS = {"l": lambda t: C.number_of(t).try_cast("long"), "o": lambda t: C.number_of(t).try_cast("long"), "d": C.number_of, "t": lambda t: t, "D": C.date_of, "b": C.flag_of, "u": F.upper}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and _seq of the lines of text files: split at line feeds only, one trailing carriage return cut.

    Empty lines are left out, malformed UTF-8 is replaced, and a line beyond MAX_LINE characters fails the read. _seq
    keeps the order of filing, however Spark splits the files: by the file's name, the place where the line's split of
    it begins, and the line's number there. At most MOST_FILES files of up to a TiB are told apart.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    names = sorted(read.inputFiles())
    if len(names) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    number = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i).cast("long"))]), F.col("_metadata.file_path")) if names else F.lit(0).cast("long")
    block = F.shiftright(F.col("_metadata.file_block_start"), 16)  # splits are no shorter than 64 KiB
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 30) - 1))
    raw = read.select(F.regexp_replace(F.make_valid_utf8("value"), "\r$", "").alias("value"), F.shiftleft(number, 54).bitwiseOR(F.shiftleft(block, 30)).bitwiseOR(line).alias("_seq"))
    checked = F.when(F.length("value") > MAX_LINE, F.raise_error(F.lit(f"a line of over {MAX_LINE} characters is no record"))).otherwise(F.col("value"))
    return raw.where(F.col("value") != "").withColumn("value", checked)


def split(lines: DataFrame, type_: str) -> DataFrame:
    """Adds __f, a record's fields, or null for a line that is no record of the type (wrong type or field count).

    The fields come out of a generator, which no filter or projection above is pushed through: a line is split once,
    however many fields are read from it.
    """
    fields = F.split("value", r"\|")
    return lines.select("*", F.explode(F.array(fields)).alias("__s")).withColumn("__f", F.when((F.size("__s") == LAYOUTS[type_].fields) & (F.col("__s")[0] == type_), F.col("__s"))).drop("__s")


def _typed(lines: DataFrame, type_: str, also: tuple[str, ...] = ()) -> DataFrame:
    """One struct of trimmed fields by name for each line, then their values; __ok says whether the line is accepted."""
    layout = LAYOUTS[type_]
    trimmed = F.struct(*[C.text(F.col("__f")[position - 1]).alias(name) for position, name, _ in layout.columns()])
    kept = [c for c in ("_seq", "service_group") if c in lines.columns and (c == "_seq" or type_ == "HD")] + list(also)
    own = split(lines, type_).select(*kept, F.col("__f").isNotNull().alias("__shape"), F.explode(F.array(trimmed)).alias("__t"))
    values = {name: _KINDS[kind](F.col(f"__t.{name}")) for _, name, kind in layout.columns()}
    ok = F.col("__shape")
    for _, name, kind in layout.columns():
        if name in layout.required:
            ok = ok & values[name].isNotNull()
        elif kind == "o":
            ok = ok & (values[name].isNotNull() | F.col(f"__t.{name}").isNull())
    return own.select(*kept, ok.alias("__ok"), *[v.alias(n) for n, v in values.items()])


def decode(lines: DataFrame, type_: str) -> DataFrame:
    """Typed records of one type with _seq, heads (HD) with service_group if lines have it; lines with a wrong shape or a missing or malformed key are left out."""
    made = _typed(lines, type_).where("__ok").drop("__ok")
    if type_ == "HD":
        return made
    if type_ == "EN":
        parts = F.col("part_1").isNotNull() | F.col("part_2").isNotNull() | F.col("part_3").isNotNull() | F.col("part_4").isNotNull()
        return made.withColumn("has_name_parts", parts).drop("part_1", "part_2", "part_3", "part_4")
    if type_ == "LO":
        parts = [f"{s}_{p}" for s in ("lat", "lon") for p in "dmsh"]
        shown = F.concat_ws(" ", *[C.dms_text([F.col(f"{s}_{p}") for p in "dmsh"]) for s in ("lat", "lon")])
        made = made.withColumns({f"__{p}": C.number_of(F.col(p)) for p in parts if p[-1] != "h"} | {"coord_dms": F.nullif(shown, F.lit(""))})
        decimals = {s: C.dms_decimal(*[F.col(f"__{s}_{p}") for p in "dms"], F.col(f"{s}_h"), axis) for s, axis in (("lat", "latitude"), ("lon", "longitude"))}
        made = made.withColumns({f"__{s}": d for s, d in decimals.items()})
        located = F.col("__lat").isNotNull() & F.col("__lon").isNotNull() & ~((F.col("__lat") == 0) & (F.col("__lon") == 0))
        made = made.withColumns({s: F.when(located, F.col(f"__{s}")) for s in ("lat", "lon")})
        return made.drop(*parts, *[f"__{p}" for p in parts if p[-1] != "h"], "__lat", "__lon")
    return made


def line_counts(lines: DataFrame, type_: str, by: list[str]) -> DataFrame:
    """by, record_type, lines_read, lines_kept and lines_rejected of one type, in one pass."""
    ok = F.coalesce(F.col("__ok"), F.lit(False))
    return _typed(lines, type_, tuple(by)).groupBy(*by).agg(F.lit(type_).alias("record_type"), F.count("*").alias("lines_read"), F.count_if(ok).alias("lines_kept"), F.count_if(~ok).alias("lines_rejected"))


def line_statistics(lines: DataFrame, type_: str) -> DataFrame:
    """record_type, lines_read, lines_kept and lines_rejected of one type, in one pass."""
    ok = F.coalesce(F.col("__ok"), F.lit(False))
    return _typed(lines, type_).agg(F.lit(type_).alias("record_type"), F.count("*").alias("lines_read"), F.count_if(ok).alias("lines_kept"), F.count_if(~ok).alias("lines_rejected"))
