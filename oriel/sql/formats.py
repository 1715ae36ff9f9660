"""Oracle format models as Spark patterns."""

from __future__ import annotations

import re

from .lexer import UnsupportedSyntax

# fixed values: elements of date formats and their Spark patterns
DATE_ELEMENTS = {
    "YYYY": "yyyy", "SYYYY": "yyyy", "RRRR": "yyyy", "YY": "yy", "RR": "yy", "Q": "q", "MM": "MM", "MONTH": "MMMM", "MON": "MMM",
    "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss",
    "FF1": "S", "FF2": "SS", "FF3": "SSS", "FF4": "SSSS", "FF5": "SSSSS", "FF6": "SSSSSS", "FF9": "SSSSSSSSS", "FF": "SSSSSS",
    "AM": "a", "PM": "a", "A.M.": "a", "P.M.": "a", "TZH:TZM": "XXX", "TZR": "VV",
}
_DATE = re.compile("|".join(re.escape(e) for e in sorted(DATE_ELEMENTS, key=len, reverse=True)) + r'|"[^"]*"|FX|FM|[-/,.;: ]', re.I)
#: Units of TRUNC and ROUND on dates.
TRUNC_UNITS = {
    "YEAR": "YEAR", "YYYY": "YEAR", "YY": "YEAR", "Y": "YEAR", "SYYYY": "YEAR", "Q": "QUARTER", "MONTH": "MONTH", "MON": "MONTH", "MM": "MONTH",
    "IW": "WEEK", "DDD": "DAY", "DD": "DAY", "J": "DAY", "HH": "HOUR", "HH12": "HOUR", "HH24": "HOUR", "MI": "MINUTE",
}


def is_number_format(fmt: str) -> bool:
    return bool(re.fullmatch(r"(FM)?[09.,DGSL$BMIPRXV ]+", fmt, re.I)) and bool(re.search("[09X]", fmt))


def date_pattern(fmt: str) -> str:
    out, at = [], 0
    while at < len(fmt):
        m = _DATE.match(fmt, at)
        if m is None:
            raise UnsupportedSyntax(f"date format element {fmt[at:at + 6]!r}", at, fmt)
        piece, at = m.group(), m.end()
        if piece[0] == '"':
            out.append("'" + piece[1:-1].replace("'", "''") + "'")
        elif piece.upper() not in ("FM", "FX"):
            out.append(DATE_ELEMENTS.get(piece.upper(), piece))
    return "".join(out)
