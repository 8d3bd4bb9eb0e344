"""Dates as printed, and as ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let, trim

#: The formats tried, in order. Month names are English.
FORMATS = ("dd.MM.yyyy", "d.M.yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "d. MMMM yyyy", "MMMM d, yyyy", "dd.MM.yy")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
YEARS = (1990, 2100)

#: For each format an expression of its parts, and the groups of year, month and day.
_NAMES = "|".join(MONTHS)
_SHAPES = {
    "dd.MM.yyyy": (r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{1,4})$", 3, 2, 1),
    "d.M.yyyy": (r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{1,4})$", 3, 2, 1),
    "yyyy-MM-dd": (r"^([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})$", 1, 2, 3),
    "dd/MM/yyyy": (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{1,4})$", 3, 2, 1),
    "d. MMMM yyyy": (rf"(?i)^([0-9]{{1,2}})\. ({_NAMES}) ([0-9]{{1,4}})$", 3, 2, 1),
    "MMMM d, yyyy": (rf"(?i)^({_NAMES}) ([0-9]{{1,2}}), ([0-9]{{1,4}})$", 3, 1, 2),
    "dd.MM.yy": (r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{2})$", 3, 2, 1),
}


def _one(s: Column, fmt: str) -> Column:
    shape, y, m, d = _SHAPES[fmt]
    year, month, day = (F.regexp_extract(s, shape, i) for i in (y, m, d))
    number = F.array_position(F.array(*[F.lit(x.lower()) for x in MONTHS]), F.lower(month)).cast("int") if "MMMM" in fmt else month.try_cast("int")
    value = year.try_cast("int")
    if fmt.endswith(".yy"):  # two digits: the nearest to 2000, so 50 and later are of the last century
        value = F.when(value < 50, value + 2000).otherwise(value + 1900)
    value = F.when(value.between(*YEARS), value)
    text = F.format_string("%04d-%02d-%02d", value, number, day.try_cast("int"))
    return F.when(s.rlike(shape) & value.isNotNull() & number.isNotNull(), F.date_format(text.try_cast("date"), "yyyy-MM-dd"))


def parse_date(text: Column | str, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that gives a real day of the years 1990 to 2100, as an ISO string; else null. The whole text
    must be the date. Two-digit years of 50 to 89 fall outside these years."""
    return let(trim(text), lambda s: F.coalesce(*[_one(s, f) for f in formats]))


def parse_date_listed(text: Column | str, formats: Column) -> Column:
    """The same under a list of formats that each row brings along."""
    s = trim(text)
    tried = F.transform(formats, lambda f: F.coalesce(*[F.when(f == k, _one(s, k)) for k in _SHAPES]))
    return F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0))


def render_date(iso: Column | str, fmt: str) -> Column:
    return F.date_format(_col(iso).try_cast("date"), fmt)
