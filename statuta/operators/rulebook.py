"""The rule catalogue: small driver-side tables that are compiled into Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from statuta import constants as K


@dataclass(frozen=True)
class Prohibition:
    id: str
    fields: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    exception: str = ""
    basis: tuple[str, ...] = ()
    citation: str = ""
    certainty: str = "wahrscheinlich"
    reason: str = ""


@dataclass(frozen=True)
class ProductRule:
    id: str
    fields: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    basis: tuple[str, ...] = ()
    reason: str = ""
    carrier_field: str = "eingebaut_in_produkt"


@dataclass(frozen=True)
class AreaRule:
    id: str
    title: str = ""
    strong: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    carriers: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    basis: tuple[str, ...] = ()


@dataclass(frozen=True)
class ExceptionRule:
    id: str
    basis: tuple[str, ...] = ()
    reason: str = ""
    cases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    no_influence: tuple[str, ...] = ()
    counter_id: str = "h6-3-profiling"
    counter_basis: tuple[str, ...] = ()
    counter_reason: str = ""
    counter_field: str = "trifft_entscheidungen_ueber_menschen"


@dataclass(frozen=True)
class TransparencyRule:
    id: str
    fields: tuple[str, ...] = ()
    any_of_fields: tuple[tuple[str, ...], ...] = ()
    roles: tuple[str, ...] = ()
    basis: tuple[str, ...] = ()
    reason: str = ""


@dataclass(frozen=True)
class ModelRule:
    id: str
    fields: tuple[str, ...] = ()
    relief: tuple[str, ...] = ()
    basis: tuple[str, ...] = ()
    reason: str = ""
    systemic_id: str = "g51-systemisch"
    systemic_basis: tuple[str, ...] = ()
    threshold: float = K.SYSTEMIC_FLOP


@dataclass(frozen=True)
class Duty:
    id: str
    title: str = ""
    action: str = ""
    basis: tuple[str, ...] = ()
    also_cited: tuple[str, ...] = ()
    citation: str = ""
    roles: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    severity: str = "pflicht"
    valid_from: date | None = None
    only_if: tuple[str, ...] = ()
    only_if_all: tuple[str, ...] = ()
    if_unknown: str = "mit_vorbehalt"
    reservation: str = ""
    proof: str = ""
    sanction: str = ""


@dataclass(frozen=True)
class PrivacySection:
    id: str
    title: str = ""
    action: str = ""
    basis: tuple[str, ...] = ()
    citation: str = ""


@dataclass(frozen=True)
class RuleBook:
    features: dict[str, tuple[str, ...]] = field(default_factory=dict)
    biometric_carriers: tuple[str, ...] = ()
    safety_exception: tuple[str, ...] = ()
    prohibitions: tuple[Prohibition, ...] = ()
    product: ProductRule | None = None
    areas: tuple[AreaRule, ...] = ()
    area_relief: tuple[str, ...] = ()
    exception: ExceptionRule | None = None
    transparency: tuple[TransparencyRule, ...] = ()
    model: ModelRule | None = None
    minimal_id: str = "m-minimal"
    minimal_basis: tuple[str, ...] = ()
    minimal_reason: str = ""
    duties: tuple[Duty, ...] = ()
    privacy: tuple[PrivacySection, ...] = ()
    deadlines: tuple[tuple[date, str], ...] = ()
    as_of: date | None = None

    def condition_fields(self) -> set[str]:
        """Every field a rule or a duty condition names."""
        named: set[str] = set()
        for p in self.prohibitions:
            named |= set(p.fields)
        for rule in (self.product, self.model):
            named |= set(rule.fields) if rule else set()
        if self.product:
            named.add(self.product.carrier_field)
        if self.exception:
            named.add(self.exception.counter_field)
        for t in self.transparency:
            named |= set(t.fields)
            for alternative in t.any_of_fields:
                named |= set(alternative)
        for d in self.duties:
            named |= set(d.only_if) | set(d.only_if_all)
        return named

    def known_fields(self) -> set[str]:
        """What a condition can ever see: attributes and features derived from text."""
        return {*K.BOOLEAN_FIELDS, *K.EXTRA_BOOLEAN_FIELDS, *self.features}

    def citations(self) -> list[tuple[str, str]]:
        """(rule id, unit key) for every legal basis in the catalogue."""
        out: list[tuple[str, str]] = []
        for rule in (*self.prohibitions, *self.areas, *self.transparency, *self.duties, *self.privacy):
            out += [(rule.id, key) for key in rule.basis]
        for rule in (self.product, self.exception, self.model):
            if rule:
                out += [(rule.id, key) for key in rule.basis]
        return out
