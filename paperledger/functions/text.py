"""Labels, tokens and patterns as Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: ASCII's, the Unicode separators (a no-break space is common in print) and the byte order mark.
SPACE_SIGNS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The class asks first for the signs outside ``!`` to ``~``, so that most are told at once.
SPACE = rf"[\x00-\x20\x7F-\uFFFF&&[{SPACE_SIGNS}]]"


def spaced(pattern: str) -> str:
    """An expression with all white space in the place of each ``\\s`` that stands outside a class."""
    return pattern.replace(r"\s", SPACE)


def _folding() -> tuple[str, str]:
    """Accented letters up to U+024F and of the Vietnamese block, and their bases, by canonical decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code) and len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folding()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once and named, so that expressions do not grow by its copies."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bound(use, *values: Column) -> Column:
    """``use`` of all values, each computed once: inside a lambda a column that the optimizer inlines is computed for
    every element."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return let(named, lambda s: use(*[s[f"v{i}"] for i in range(len(values))]))


def trim(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def clean(text: Column | str) -> Column:
    """Trimmed, and null where nothing is left."""
    return F.nullif(trim(text), F.lit(""))


def _if_foreign(text: Column, use) -> Column:
    """``use(text)`` where the text has any sign beyond ASCII; the table lookup is the dear part of folding."""
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), use(t)).otherwise(t))


def strip_marks(text: Column | str) -> Column:
    """Letters without their accents; combining marks go."""
    return _if_foreign(_col(text), lambda t: F.regexp_replace(F.translate(t, _ACCENTED, _PLAIN), "[̀-ͯ]", ""))


def normalize_label(text: Column | str) -> Column:
    """Lower case, no accents, and of the rest only a-z, 0-9 and %. A sharp s vanishes, as it has no decomposition."""
    return F.regexp_replace(strip_marks(F.lower(_col(text))), "[^a-z0-9%]", "")


def normalize_token(text: Column | str) -> Column:
    """Lower case, sharp s as ss, no accents."""
    return strip_marks(F.replace(F.lower(_col(text)), F.lit("ß"), F.lit("ss")))


def normalize_letters(text: Column | str) -> Column:
    """``normalize_token`` of each run of letters of a text, with all else as it is; combining marks still separate."""
    plain = F.lower(F.replace(_col(text), F.lit("\u0130"), F.lit("i")))
    return _if_foreign(plain, lambda t: F.translate(F.replace(t, F.lit("ß"), F.lit("ss")), _ACCENTED, _PLAIN))


def characters(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), ""), lambda c: c != "")


def fold(text: Column | str) -> Column:
    """Lower case without accents, sign for sign, so that places in the text stay what they are."""
    return _if_foreign(F.lower(_col(text)), lambda t: F.translate(t, _ACCENTED, _PLAIN))


def plain_label(label: str) -> str:
    """``normalize_label`` of a Python string."""
    folded = "".join(c for c in unicodedata.normalize("NFD", label.lower()) if not unicodedata.combining(c))
    return "".join(c for c in folded if c in "abcdefghijklmnopqrstuvwxyz0123456789%")


def label_expression(label: str) -> str:
    """Matches the start of a folded text up to the sign that completes the label."""
    return "^" + "".join(f"[^a-z0-9%]*{c}" for c in plain_label(label))


def label_end(folded: Column, label: str) -> Column:
    """How many characters of a text complete the label at its start; 0 where it does not start so."""
    return F.length(F.regexp_extract(folded, label_expression(label), 0))


def remainder(text: Column | str, end: Column) -> Column:
    """What follows a label, without leading dots, colons and white space."""
    text = _col(text)
    return F.regexp_replace(F.substring(text, end + 1, F.length(text)), rf"^(?:[.:]|{SPACE})+", "")


def label_end_anywhere(text: Column | str, label: Column) -> Column:
    """The end of the first occurrence of a label in any case, else of the shortest start of the text whose normal form
    ends with the label's; null without either."""
    def walk(t: Column) -> Column:
        target = normalize_label(label)
        plain = F.regexp_replace(fold(t), "[^a-z0-9%]", "")
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda n: F.endswith(normalize_label(F.substring(t, F.lit(1), n)), target))
        at = F.instr(F.lower(t), F.lower(label))
        return F.when(at > 0, at - 1 + F.length(label)).when(F.contains(plain, target), F.get(ends, F.lit(0)))

    return let(_col(text), walk)


def generalize_pattern(raw: Column | str) -> Column:
    """An expression for values of this shape: signs escaped, runs of digits as any digits."""
    return F.regexp_replace(F.regexp_replace(_col(raw), r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"[0-9]+", r"\\d+")


def label_before(text: Column | str, start: Column) -> Column:
    """The text before a value, without closing colons, if it has 2 to 60 characters."""
    before = trim(F.regexp_replace(F.substring(_col(text), F.lit(1), start), rf"(?:[:]|{SPACE})+$", ""))
    return F.when(F.length(before).between(2, 60), before)


def strip_fences(text: Column | str) -> Column:
    """A reply of a model without one pair of code fences."""
    opened = F.regexp_replace(trim(text), rf"(?i)^```(?:json)?{SPACE}*", "")
    return trim(F.regexp_replace(opened, rf"{SPACE}*```$", ""))
