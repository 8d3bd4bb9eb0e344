"""Amounts as printed, and as dot-decimal strings. Nothing passes through a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, _col, let, trim

#: The currency marks that a printed amount may carry.
CURRENCY = r"(?i)EUR|€|USD|\$|GBP|£|CHF"
#: Texts that are their amount but for the separators: digits alone, and a fraction of one or two digits behind groups.
WHOLE = r"^-?[0-9]{1,12}\z"
COMMA = r"^-?(?:[0-9]{1,12}|[0-9]{1,3}(?:\.[0-9]{3}){1,3}),[0-9]{1,2}\z"
POINT = r"^-?(?:[0-9]{1,12}|[0-9]{1,3}(?:,[0-9]{3}){1,3})\.[0-9]{1,2}\z"


def _after(text: Column, sign: Column) -> Column:
    """What follows the last ``sign``."""
    return F.call_function("substring_index", text, sign, F.lit(-1))


def strip_noise(text: Column | str) -> Column:
    """Digits, separators and signs alone."""
    return F.regexp_replace(F.regexp_replace(_col(text), CURRENCY, ""), r"[^0-9.,\-+]", "")


def detect_separator(text: Column | str) -> Column:
    """The last of dot and comma, if one or two digits end the text after it; else null."""
    return F.nullif(F.regexp_extract(strip_noise(text), r"([.,])[0-9]{1,2}$", 1), F.lit(""))


def holds_multiple(text: Column | str) -> Column:
    """Whether two amounts stand side by side. Groups of three digits between spaces are one amount, and only its last
    group may carry a fraction. Parts without digits do not count."""
    bare = F.regexp_replace(F.regexp_replace(_col(text), CURRENCY, ""), rf"^{SPACE}*([-+]){SPACE}*", "$1")

    def any_apart(parts: Column) -> Column:
        def apart(p: Column, i: Column) -> Column:
            head, tail, middle = p.rlike(r"^[-+]?[0-9]{1,3}$"), p.rlike(r"^[0-9]{3}([.,][0-9]{1,4})?$"), p.rlike("^[0-9]{3}$")
            return ~F.when(i == 0, head).when(i == F.size(parts) - 1, tail).otherwise(middle)

        return (F.size(parts) > 1) & F.exists(F.transform(parts, apart), lambda x: x)

    return let(F.filter(F.split(trim(bare), f"{SPACE}+"), lambda p: p.rlike("[0-9]")), any_apart)


def parse_amount(text: Column | str, decimal: Column | None = None) -> Column:
    """The amount as a dot-decimal string with its zeros kept, or null. ``decimal`` pins the separator."""

    def split(s: Column) -> Column:
        sep = F.coalesce(decimal, detect_separator(s)) if decimal is not None else detect_separator(s)
        return F.struct(s.alias("s"), let(sep, lambda x: F.when(x.isNotNull() & (F.instr(s, x) > 0), _after(s, x))).alias("after"))

    def whole(p: Column) -> Column:
        digits = F.regexp_replace(F.when(p["after"].isNull(), p["s"]).otherwise(F.substring(p["s"], F.lit(1), F.length(p["s"]) - F.length(p["after"]) - 1)), "[.,]", "")
        return F.struct(p["s"].alias("s"), p["after"].alias("after"), F.when(digits == "", F.lit("0")).otherwise(digits).alias("digits"))

    def value(t: Column, signed: Column, p: Column) -> Column:
        good = ~holds_multiple(t) & p["s"].rlike(r"^[0-9][0-9.,]*$") & p["digits"].rlike("^[0-9]{1,12}$") & (p["after"].isNull() | p["after"].rlike("^[0-9]{1,4}$"))
        sign = F.when(F.startswith(signed, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        return F.when(good, F.concat(sign, p["digits"], F.coalesce(F.concat(F.lit("."), p["after"]), F.lit(""))))

    def plain(t: Column) -> Column:
        """Most amounts: one expression tells their shape, where the whole way takes a dozen."""
        comma, point = t.rlike(COMMA), t.rlike(POINT)
        if decimal is not None:
            comma, point = comma & (decimal == ","), point & (decimal == ".")
        return F.when(t.rlike(WHOLE), t).when(comma, F.translate(t, ",.", ".")).when(point, F.translate(t, ".,", ".")).otherwise(parse(t))

    def parse(t: Column) -> Column:
        return let(strip_noise(t), lambda signed: let(F.regexp_replace(signed, "^[-+]", ""), lambda s: let(split(s), lambda p: let(whole(p), lambda w: value(t, signed, w)))))

    return let(_col(text), plain)


def render_amount(dot_decimal: Column | str, decimal: str | Column, grouped: bool = True) -> Column:
    """A dot-decimal string in a locale: ``decimal`` is its separator, the other sign groups."""
    sep = F.lit(decimal) if isinstance(decimal, str) else decimal
    group = F.when(sep == ",", F.lit(".")).otherwise(F.lit(","))

    def render(v: Column) -> Column:
        whole = F.substring_index(F.regexp_replace(v, "^-", ""), ".", 1)
        if grouped:
            whole = F.replace(F.regexp_replace(whole, r"\B(?=(?:[0-9]{3})+$)", "_"), F.lit("_"), group)
        fraction = F.when(F.instr(v, ".") > 0, F.concat(sep, F.substring_index(v, ".", -1))).otherwise(F.lit(""))
        return F.concat(F.when(F.startswith(v, F.lit("-")), F.lit("-")).otherwise(F.lit("")), whole, F.when(fraction == sep, F.lit("")).otherwise(fraction))

    return let(_col(dot_decimal), render)


def to_decimal(text: Column | str) -> Column:
    """DECIMAL(18,4) of a dot-decimal string; null for blanks and anything else."""
    return trim(text).try_cast("decimal(18,4)")


def money(value: Column | str) -> Column:
    """Two places, half up."""
    return F.round(_col(value), 2).cast("decimal(18,2)").cast("string")


def quantity(value: Column | str) -> Column:
    """At most four places, half up, without closing zeros."""
    text = F.round(_col(value), 4).cast("decimal(18,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def bare_number(x: Column) -> Column:
    """A dot-decimal string without zeros that change nothing."""
    def short(x: Column) -> Column:
        cut = let(F.rtrim(x, F.lit("0")), lambda y: F.when(F.endswith(y, F.lit(".")), F.substring(y, F.lit(1), F.length(y) - 1)).otherwise(y))
        return F.when(F.instr(x, ".") > 0, cut).otherwise(x)

    def plain(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit("0")) | F.startswith(x, F.lit("-0")), F.regexp_replace(x, r"^(-?)0+(?=[0-9])", "$1")).otherwise(x)

    return let(let(x, short), plain)


def number_equal(a: Column | str, b: Column | str) -> Column:
    """Whether two dot-decimal strings are one number, whatever zeros they carry; false where either is null."""
    return F.coalesce(bare_number(_col(a)) == bare_number(_col(b)), F.lit(False))


def cell_to_dot(cell: Column | str, decimal: Column) -> Column:
    """A table cell under a pinned separator as a dot-decimal string, or null where it is no number."""
    def parted(s: Column) -> Column:
        return let(F.when(F.instr(s, decimal) > 0, _after(s, decimal)), lambda after: F.when(after.rlike("^[0-9]{1,4}$"), joined(s, after)).otherwise(F.regexp_replace(s, "[.,]", "")))

    def joined(s: Column, after: Column) -> Column:
        before = F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - F.length(after) - 1), "[.,]", "")
        return let(before, lambda b: F.concat(F.when(b == "", F.lit("0")).otherwise(b), F.lit("."), after))

    return let(trim(F.regexp_replace(_col(cell), "(?i)EUR|€", "")), lambda s: F.when(s.rlike(r"^-?[0-9.,]+$"), parted(s)))
