"""Duties, privacy sections, deadlines and penalties that follow from a classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.phrases import literal_hit
from statuta.operators.features import derived, value
from statuta.operators.rulebook import Duty, RuleBook

DUTY_TYPE = (
    "array<struct<severity_rank:int,citation:string,id:string,title:string,action:string,"
    "valid_from:date,reservation:string,severity:string>>"
)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _overlaps(column: str, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted]))


def duty_applies(duty: Duty) -> Column:
    """Classes and roles intersect; an empty side of the catalogue does not restrict."""
    tests = []
    if duty.classes:
        tests.append(_overlaps("classes", duty.classes))
    if duty.roles:
        tests.append(_overlaps("effective_roles", duty.roles))
    return _all(tests)


def feature_gate(duty: Duty) -> tuple[Column, Column]:
    """(named, reservation) of a duty that hangs on features, in three-valued logic.

    `only_if_all`: any feature not true drops the duty when one is false or the policy is to leave
    it out; otherwise it is named with its reservation and the any-of list is not looked at.
    """
    yes, text = F.lit(True), F.lit("")
    named, reservation = yes, text
    if duty.only_if:
        values = [value(m) for m in duty.only_if]
        some = _any([F.coalesce(v, F.lit(False)) for v in values])
        none = _all([F.coalesce(~v, F.lit(False)) for v in values])
        leave_out = duty.if_unknown == "weglassen"
        named = some | ~(none | F.lit(leave_out))
        own = duty.reservation or "gilt nur mit " + " oder ".join(m.replace("_", " ") for m in duty.only_if)
        reservation = F.when(some, "").otherwise(own)
    if duty.only_if_all:
        values = [value(m) for m in duty.only_if_all]
        met = _all([F.coalesce(v, F.lit(False)) for v in values])
        denied = _any([F.coalesce(~v, F.lit(False)) for v in values])
        kept = F.lit(duty.if_unknown != "weglassen") & ~denied
        named = F.when(met, named).otherwise(kept)
        reservation = F.when(met, reservation).otherwise(duty.reservation)
    return named, reservation


def duty_array(book: RuleBook) -> Column:
    """Duties of a row as an array ordered by severity rank, citation, id."""
    rows = []
    for d in book.duties:
        named, reservation = feature_gate(d)
        rows.append(
            F.when(
                duty_applies(d) & named,
                F.struct(
                    F.lit(K.SEVERITY_RANK.get(d.severity, 0)).alias("severity_rank"),
                    F.lit(d.citation).alias("citation"),
                    F.lit(d.id).alias("id"),
                    F.lit(d.title).alias("title"),
                    F.lit(d.action).alias("action"),
                    F.lit(d.valid_from).cast("date").alias("valid_from"),
                    reservation.alias("reservation"),
                    F.lit(d.severity).alias("severity"),
                ),
            )
        )
    if not rows:
        return F.array().cast(DUTY_TYPE)
    return F.array_sort(F.array_compact(F.array(*rows)))


def privacy_condition(name: str) -> Column:
    if name == "immer_bei_ki":
        return F.lit(True)
    if name == "hohes_risiko":
        return _overlaps("classes", K.HIGH_RISK)
    if name == "viele_beschaeftigte":
        return F.coalesce(F.col("anzahl_beschaeftigte") >= K.MANY_EMPLOYEES, F.lit(False))
    if name == "training_mit_daten":
        return literal_hit(F.col("_t2"), K.TRAINING_PHRASES)
    if name == "zugekauft":
        return literal_hit(F.col("_t1"), K.PURCHASED_PHRASES)
    if name == "eigenentwicklung":
        return F.array_contains("roles", "anbieter")
    return F.coalesce(value(name), F.lit(False))


def privacy_array(book: RuleBook) -> Column:
    """Privacy sections that apply; sections without a known condition are always kept."""
    rows = []
    for s in book.privacy:
        tests = [privacy_condition(c) for c in K.PRIVACY_CONDITIONS.get(s.id, ())]
        rows.append(
            F.when(
                _all(tests),
                F.struct(
                    F.lit(s.id).alias("id"),
                    F.lit(s.title).alias("title"),
                    F.lit(s.citation).alias("citation"),
                    F.lit(s.action).alias("action"),
                ),
            )
        )
    kind = "array<struct<id:string,title:string,citation:string,action:string>>"
    if not rows:
        return F.array().cast(kind)
    personal = value("verarbeitet_personenbezogene_daten")
    return F.when(F.coalesce(~personal, F.lit(False)), F.array().cast(kind)).otherwise(
        F.array_compact(F.array(*rows))
    )


def match_duties(described: DataFrame, duties: DataFrame, key: str) -> DataFrame:
    """Duty tables too large to compile: (key, classes, effective_roles) × (duty_id, classes, roles).

    Both sides are exploded to (class, role) and joined on equality; an empty side of the catalogue
    stands for every value and is joined through a wildcard.
    """
    mine = described.select(
        key,
        F.explode(F.array_append("classes", F.lit("*"))).alias("c"),
        F.col("effective_roles"),
    ).select(key, "c", F.explode(F.array_append("effective_roles", F.lit("*"))).alias("r"))
    wild = F.array(F.lit("*"))
    theirs = duties.select(
        "duty_id",
        F.explode(F.when(F.size("classes") == 0, wild).otherwise(F.col("classes"))).alias("c"),
        F.col("roles"),
    ).select(
        "duty_id",
        "c",
        F.explode(F.when(F.size("roles") == 0, wild).otherwise(F.col("roles"))).alias("r"),
    )
    from statuta.operators.scale import lookup_join

    return lookup_join(mine, theirs, ["c", "r"]).select(key, "duty_id").distinct()


def in_force(deadline: Column, as_of: Column) -> Column:
    return deadline <= as_of


def valid_at(valid_from: Column, as_of: Column) -> Column:
    """A duty without a date is always valid."""
    return valid_from.isNull() | (valid_from <= as_of)


def order_deadlines(deadlines: DataFrame, group: str, tie: str) -> DataFrame:
    order = W.partitionBy(group).orderBy("deadline", tie)
    return deadlines.withColumn("pos", F.row_number().over(order))


def penalty(turnover: Column, cap_eur: Column, cap_pct: Column, small: Column) -> Column:
    """The higher of fixed cap and share of turnover; small firms pay the lower."""
    share = turnover * cap_pct / 100
    return F.when(small, F.least(cap_eur, share)).otherwise(F.greatest(cap_eur, share))
