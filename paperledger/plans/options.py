"""Options with their defaults. A JSON object of the same sections overrides any of them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

#: The weights and bands of the document classifier, and the closed set of VAT rates.
WEIGHTS = {"heading_keyword": 3, "number_pattern": 2, "tax_id": 2, "labelled_date": 1, "vat_block": 2, "amount_table": 2}
INVOICE_MIN, NON_INVOICE_MAX = 7, 3
VAT_RATES = ("19", "7", "0")


@dataclass(frozen=True)
class Reconcile:
    vat_rates: tuple[str, ...] = VAT_RATES
    tolerance_header: str = "0.02"
    tolerance_line: str = "0.01"
    slack_per_line: str = "0.005"
    passes: int = 5
    currency: str = "EUR"


@dataclass(frozen=True)
class Gate:
    least_hit_rate: float = 0.55
    most_replacement: float = 0.05
    most_single: float = 0.4
    least_tokens: int = 10


@dataclass(frozen=True)
class Triage:
    pages: int = 3
    least_characters: int = 50


@dataclass(frozen=True)
class Classify:
    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    invoice_min: int = INVOICE_MIN
    non_invoice_max: int = NON_INVOICE_MAX


@dataclass(frozen=True)
class Options:
    reconcile: Reconcile = Reconcile()
    gate: Gate = Gate()
    triage: Triage = Triage()
    classify: Classify = field(default_factory=Classify)
    induce_from_rules: bool = True
    model_enabled: bool = False
    most_pages: int = 5
    dpi: int = 150
    most_attempts: int = 3


def read_options(path: str | None = None, environment: dict[str, str] | None = None) -> Options:
    """Options from a JSON file, then from PAPERLEDGER_<NAME> variables; unknown names are errors."""
    given = json.loads(open(path).read()) if path else {}
    env = os.environ if environment is None else environment
    made = Options()
    for name, value in given.items():
        if name not in {f.name for f in fields(Options)}:
            raise ValueError(f"unknown option {name!r}")
        now = getattr(made, name)
        if isinstance(value, dict):
            bad = set(value) - {f.name for f in fields(now)}
            if bad:
                raise ValueError(f"unknown options {sorted(bad)} in {name!r}")
            value = replace(now, **{k: tuple(map(str, v)) if isinstance(v, list) else v for k, v in value.items()})
        made = replace(made, **{name: value})
    for f in fields(Options):
        text = env.get(f"PAPERLEDGER_{f.name.upper()}")
        if text is not None and not hasattr(getattr(made, f.name), "__dataclass_fields__"):
            now = getattr(made, f.name)
            made = replace(made, **{f.name: text.lower() in ("1", "true") if isinstance(now, bool) else type(now)(text)})
    return made
