"""Field decoding and derived values as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes

#: The characters of decimal numbers; words such as NaN, hexadecimal and suffixes have others.
_WRITTEN = "0123456789+-.eE"


#: Every white space character, by Unicode's own property, and the byte order mark.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F and c != 0x85) + "\ufeff"


def text(value: Column) -> Column:
    """Trimmed of any Unicode white space; empty is null."""
    return F.nullif(F.btrim(value, F.lit(WHITE)), F.lit(""))


def number(value: Column) -> Column:
    """A finite decimal number, else null; hexadecimal and words such as NaN are no numbers."""
    return number_of(text(value))


def number_of(own: Column) -> Column:
    """The same of a field that has been trimmed: what numbers aren't written with is tested before the cast."""
    made = F.when(F.translate(own, _WRITTEN, "") == "", own.try_cast("double"))
    return F.nullif(F.nullif(made, F.lit(float("inf"))), F.lit(float("-inf")))


def whole(value: Column) -> Column:
    """A number as a long."""
    return number(value).try_cast("long")


def date(value: Column) -> Column:
    """MM/DD/YYYY as YYYY-MM-DD text by its digits alone; anything else is null."""
    return date_of(text(value))


def date_of(own: Column) -> Column:
    """The same of a field that has been trimmed."""
    return F.when(own.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.concat_ws("-", F.substring(own, 7, 4), F.substring(own, 1, 2), F.substring(own, 4, 2)))


def flag(value: Column) -> Column:
    """True for Y, false for N, else null."""
    return flag_of(text(value))


def flag_of(own: Column) -> Column:
    """The same of a field that has been trimmed."""
    own = F.upper(own)
    return F.when(own == "Y", True).when(own == "N", False)


def dms_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column, axis: str) -> Column:
    """Signed decimal degrees, null unless every part is there and in range and the hemisphere fits the axis."""
    limit, positive, negative = (90, "N", "S") if axis == "latitude" else (180, "E", "W")
    side = F.upper(hemisphere)
    value = degrees + minutes / 60 + seconds / 3600
    fits = (degrees >= 0) & minutes.between(0, 60) & (minutes < 60) & seconds.between(0, 60) & (seconds < 60) & side.isin(positive, negative) & (value <= limit)
    return F.when(fits, F.when(side == negative, -value).otherwise(value))


def dms_text(parts: list[Column]) -> Column:
    """`D-M-S H` as filed, null if degrees, minutes and seconds are all blank."""
    d, m, s, h = (F.coalesce(p, F.lit("")) for p in parts)
    shown = F.trim(F.concat(d, F.lit("-"), m, F.lit("-"), s, F.lit(" "), h))
    return F.when(parts[0].isNotNull() | parts[1].isNotNull() | parts[2].isNotNull(), shown)


#: A designator's first four characters: three digits, and the letter that is point and unit anywhere among them.
_DESIGNATOR = "^(?:[HKMG][0-9]{3}|[0-9][HKMG][0-9]{2}|[0-9]{2}[HKMG][0-9]|[0-9]{3}[HKMG])$"


def emission_mhz(designator: Column) -> Column:
    """Necessary bandwidth of an emission designator: three digits around a letter that is point and unit.

    One pattern is tested, and letter and digits are told by translation, as each further pattern would be run for each row.
    """
    head = F.substring(F.upper(F.btrim(designator, F.lit(WHITE))), 1, 4)
    value, letter = F.translate(head, "HKMG", "....").try_cast("double"), F.translate(head, "0123456789", "")
    scaled = F.when(letter == "H", value / 1e6).when(letter == "K", value / 1e3).when(letter == "M", value).otherwise(value * 1e3)
    return F.when(head.rlike(_DESIGNATOR), scaled)


def label(code: Column, table: dict[str, str], keep_unknown: bool = True) -> Column:
    """A code's label; an unknown code keeps itself, or is null if keep_unknown is false."""
    found = F.create_map(*[F.lit(x) for x in chain(*table.items())])[code]
    return F.coalesce(found, code) if keep_unknown else found


def market_states(name: Column) -> Column:
    """State codes after the last comma of a market's name, split at hyphens and slashes, distinct; null if none."""
    tail = F.when(F.instr(name, ",") > 0, F.substring_index(name, ",", -1))
    parts = F.transform(F.split(F.upper(tail), "[-/]"), lambda x: F.trim(x))
    found = F.array_distinct(F.filter(parts, lambda x: x.isin(*codes.USPS_STATES)))
    return F.when(F.size(found) > 0, found)


def has_organization_word(name: Column) -> Column:
    """Whether a name has one of the organisation words as a whole word; dotted letters count as one word."""
    joined = F.regexp_replace(F.upper(name), r"(?<![\p{L}\p{N}])((?:\p{L}\.){2,})", "$1 ")
    # Dots between single letters go: L.L.C. reads as LLC.
    joined = F.regexp_replace(joined, r"(?<=(?<![\p{L}\p{N}])\p{L})\.(?=\p{L}\.)|(?<=\.\p{L})\.", "")
    words = F.split(joined, r"[^\p{L}\p{N}]+")
    return F.coalesce(F.arrays_overlap(words, F.array(*[F.lit(w) for w in codes.ORGANIZATION_WORDS])), F.lit(False))


def is_individual(applicant_type: Column, service: Column, has_name_parts: Column, name: Column) -> Column:
    """Whether a licensee is a person; without an entity record (name parts null) the last rule doesn't hold."""
    blank = applicant_type.isNull()
    personal = service.isin("HA", "HV", "ZA")
    unsure = (blank | (applicant_type == "H")) & (has_name_parts | ~has_organization_word(name))
    return F.coalesce(F.coalesce(applicant_type == "I", F.lit(False)) | (blank & personal) | F.coalesce(unsure, F.lit(False)), F.lit(False))


def is_lease(callsign: Column) -> Column:
    """Whether a callsign is a lease's: L and nine digits."""
    return F.coalesce(callsign.rlike("^L[0-9]{9}$"), F.lit(False))


def asr_number(value: Column) -> Column:
    """An antenna structure registration if it is one: seven digits, not all nines."""
    return F.when(value.rlike("^[0-9]{7}$") & (value != "9999999"), value)
