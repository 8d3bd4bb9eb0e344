"""Vendor identifiers: checks, normal forms and the hash of a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, _col, characters, normalize_label, spaced

#: Fixed values of 32-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: A name is hashed without this legal form; whether others count is not known.
LEGAL_FORM = "gmbh"
#: Where a name may stand, and how many letters it needs. Our own choice.
TOP, NAME_LETTERS = 0.25, 3


def _compact(text: Column | str) -> Column:
    return F.upper(F.regexp_replace(_col(text), f"{SPACE}+", ""))


def valid_vat_id(text: Column | str) -> Column:
    """DE and nine digits whose last is the ISO 7064 check (modulo 11, 10)."""
    s = _compact(text)
    digits = F.transform(characters(F.substring(s, 3, 8)), lambda c: c.try_cast("int"))

    def step(product: Column, d: Column) -> Column:
        total = (d + product) % 10
        return (F.when(total == 0, 10).otherwise(total) * 2) % 11

    check = (F.lit(11) - F.aggregate(digits, F.lit(10), step)) % 10
    return F.coalesce(s.rlike("^DE[0-9]{9}$") & (check == F.substring(s, 11, 1).try_cast("int")), F.lit(False))


def normalize_iban(text: Column | str) -> Column:
    return _compact(text)


def valid_iban(text: Column | str) -> Column:
    """The shape, and 1 modulo 97 after the first four signs moved to the end."""
    s = _compact(text)
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - F.lit(55)
        return F.when(c.rlike("^[0-9]$"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + letter) % 97

    return F.coalesce(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & (F.aggregate(characters(turned), F.lit(0), step) == 1), F.lit(False))


def plausible_tax_number(text: Column | str) -> Column:
    """Two or three groups between slashes, or ten to thirteen digits; there is no check digit."""
    return F.coalesce(F.regexp_replace(_col(text), f"{SPACE}+", "").rlike(r"^([0-9]{2,3}/[0-9]{3,4}/[0-9]{4,5}|[0-9]{10,13})$"), F.lit(False))


def fnv1a(text: Column | str) -> Column:
    """Eight hexadecimal digits. The text's signs are taken as bytes: normalised labels are ASCII."""
    def step(h: Column, c: Column) -> Column:
        return (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    h = F.aggregate(characters(text), F.lit(FNV_OFFSET).cast("long"), step)
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def vendor_name_hash(name: Column | str, postal_code: Column | str) -> Column:
    plain = F.replace(normalize_label(name), F.lit(LEGAL_FORM), F.lit(""))
    code = F.coalesce(F.regexp_replace(_col(postal_code), "[^0-9A-Za-z]", ""), F.lit(""))
    return F.when(_col(name).isNotNull(), fnv1a(F.concat(plain, F.lit("|"), code)))


def extract_vendor_ids(lines: Column) -> Column:
    """From an array of lines (text, y0): vat_id, tax_number, ibans, name_guess, postal_guess and name_hash."""
    text = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")

    def first(values: Column) -> Column:
        return F.get(values, F.lit(0))

    vat = first(F.filter(F.transform(F.regexp_extract_all(text, F.lit(spaced(r"(?<![A-Za-z0-9_])DE\s?[0-9]{9}(?![A-Za-z0-9_])")), F.lit(0)), _compact), valid_vat_id))
    labelled = F.filter(lines, lambda x: x["text"].rlike("(?i)steuernummer|steuer-?nr"))
    tax = first(F.filter(F.transform(labelled, lambda x: F.regexp_extract(x["text"], r"[0-9]{2,3}/[0-9]{3,4}/[0-9]{4,5}|[0-9]{10,13}", 0)), lambda x: x != ""))
    ibans = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}(?![A-Za-z0-9_])"), F.lit(0)), _compact), valid_iban))
    name = first(F.transform(F.filter(lines, lambda x: (x["y0"] < TOP) & (F.length(F.regexp_replace(x["text"], r"[^\p{L}]", "")) >= NAME_LETTERS) & ~x["text"].rlike("[0-9]")), lambda x: x["text"]))
    postal = F.nullif(F.regexp_extract(text, r"(?<![0-9])([0-9]{5})(?![0-9])", 1), F.lit(""))
    return F.struct(vat.alias("vat_id"), tax.alias("tax_number"), ibans.alias("ibans"), name.alias("name_guess"), postal.alias("postal_guess"), vendor_name_hash(name, postal).alias("name_hash"))
