"""Query parameters as users write them, brought to the form that records use. All of this runs on the driver."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from zoneinfo import ZoneInfo

from . import codes

MAX_MHZ = 300_000.0
UNITS = {"khz": "kHz", "mhz": "MHz", "ghz": "GHz"}
_EASTERN = ZoneInfo("America/New_York")


class QueryError(ValueError):
    """A request that can't be answered; reason is one of the stable names that callers test."""

    def __init__(self, reason: str, message: str = ""):
        super().__init__(message or reason)
        self.reason = reason


def callsign(raw: str) -> str:
    """Upper case without blanks, one trailing portable suffix cut unless it looks like a callsign itself."""
    text = "".join(raw.upper().split())
    head, slash, tail = text.rpartition("/")
    portable = re.fullmatch("[A-Z0-9]{1,4}", tail) and not re.fullmatch("[A-Z]{1,2}[0-9][A-Z]+", tail)
    return head if slash and portable else text


def frn(raw: str) -> str:
    """Digits without blanks and hyphens, padded to ten."""
    text = re.sub(r"[\s-]", "", raw)
    return text.zfill(10) if re.fullmatch("[0-9]{1,10}", text) else text


def market_code(raw: str) -> str:
    """Upper case without blanks and hyphens; digits after letters are padded to six characters in all."""
    text = re.sub(r"[\s-]", "", raw.upper())
    m = re.fullmatch("([A-Z]+)([0-9]+)", text)
    return m[1] + m[2].zfill(6 - len(m[1])) if m else text


def state(raw: str) -> str:
    """A two-letter code in upper case, or the code of a full name."""
    text = raw.strip()
    return text.upper() if len(text) == 2 else codes.state_codes().get(codes.state_name_key(text), text)


def status(raw: str) -> str:
    """A status code, the code of a status label, or `any`."""
    key = " ".join(raw.lower().split()).replace("cancelled", "canceled")
    words = {" ".join(v.lower().split()): k for k, v in codes.LICENSE_STATUSES.items()} | {"pending legal": "L"}
    return "any" if key == "any" else words.get(key, raw.strip().upper())


def unit(raw: str) -> str:
    """kHz, MHz or GHz in their usual spelling."""
    return UNITS.get(raw.strip().lower(), raw)


def to_mhz(value: float, unit_: str) -> float:
    """A frequency in MHz; kHz and GHz are rounded to the millihertz so that spellings of one band agree."""
    scale = {"kHz": 1e6, "GHz": 1e12}.get(unit_)
    return value if scale is None else int(value * scale + 0.5) / 1e9


def band(low: float | None, high: float | None, unit_: str = "MHz") -> tuple[float, float] | None:
    """(low, high) in MHz, a single frequency if high is None, None without low; raises invalid_frequency_range."""
    if low is None:
        if high is not None:
            raise QueryError("invalid_frequency_range", "high_without_low")
        return None
    a = to_mhz(low, unit_)
    b = a if high is None else to_mhz(high, unit_)
    if b < a:
        raise QueryError("invalid_frequency_range", "high_below_low")
    if b > MAX_MHZ:
        raise QueryError("invalid_frequency_range", "above_max")
    return a, b


def coordinate(raw: str, axis: str) -> float | None:
    """Decimal degrees of `47.62`, or of degrees, minutes, seconds and a hemisphere; None if it isn't one."""
    if len(raw) > 48:
        return None
    text = raw.strip().upper()
    limit, letters = (90.0, "NS") if axis == "latitude" else (180.0, "EW")
    if re.fullmatch(r"[+-]?[0-9]+(\.[0-9]*)?", text):
        value = float(text)
        return value if abs(value) <= limit else None
    m = re.fullmatch(rf"([{letters}])?\s*([0-9]+)[^0-9A-Z.]+([0-9]+)[^0-9A-Z.]+([0-9]+(?:\.[0-9]+)?)[^0-9A-Z.]*\s*([{letters}])?", text)
    if not m or bool(m[1]) == bool(m[5]):
        return None
    degrees, minutes, seconds = float(m[2]), float(m[3]), float(m[4])
    value = degrees + minutes / 60 + seconds / 3600
    if minutes >= 60 or seconds >= 60 or value > limit:
        return None
    return -value if (m[1] or m[5]) in "SW" else value


def name_phrases(text: str) -> list[list[str]]:
    """A name search as phrases of folded terms: each word is one phrase of its runs of letters and digits."""
    phrases = []
    for word in unicodedata.normalize("NFKC", text).split():
        pieces = re.findall(r"[^\W_]+", word)
        if pieces:
            phrases.append([fold(p) for p in pieces])
    return phrases


def folded_name(text: str) -> str:
    """A name search as one spelling for all that search the same: its folded phrases."""
    return " ".join("&".join(p) for p in name_phrases(text))


def live_status(raw: str) -> str:
    """A status of licences whose sites are held, or `any` of them; raises invalid_status for others."""
    found = status(raw)
    if found != "any" and found not in codes.LIVE_STATUSES:
        raise QueryError("invalid_status", raw)
    return found


def degrees(raw: float | str, axis: str) -> float:
    """Decimal degrees of a number or text; raises invalid_coordinate if they are none of that axis."""
    found = coordinate(raw, axis) if isinstance(raw, str) else float(raw)
    if found is None or not abs(found) <= (90.0 if axis == "latitude" else 180.0):
        raise QueryError("invalid_coordinate", str(raw))
    return found


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def marked_letters() -> tuple[str, str]:
    """Characters below U+3000 that decompose into one character and marks, and that character for each."""
    pairs = []
    for cp in range(0x80, 0x3000):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and not unicodedata.combining(d[0]) and all(unicodedata.combining(c) for c in d[1:]):
            pairs.append((chr(cp), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def eastern_date(instant: dt.datetime) -> dt.date:
    """The calendar date of a UTC instant in US Eastern time."""
    return instant.replace(tzinfo=instant.tzinfo or dt.UTC).astimezone(_EASTERN).date()


def eastern_wall_time(wall: dt.datetime) -> dt.datetime | None:
    """The UTC instant of an Eastern wall time, or None if it occurs twice or not at all."""
    found = {wall.replace(tzinfo=_EASTERN, fold=f).astimezone(dt.UTC) for f in (0, 1)}
    exact = {u for u in found if u.astimezone(_EASTERN).replace(tzinfo=None) == wall}
    return exact.pop() if len(exact) == 1 else None


def daily_code(file_name: str) -> str | None:
    """The code of a daily file named `l_<code>_<day>.zip`, lower-cased."""
    m = re.fullmatch(r"l_([^_]+)_[^_]*\.zip", file_name.lower())
    return m[1] if m else None


def clamp(limit: int, ceiling: int) -> int:
    """A page size of at most the ceiling."""
    return min(limit, ceiling)
