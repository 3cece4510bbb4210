"""Features of a description: explicit attributes first, then what the text says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.functions.phrases import feature_hit
from statuta.functions.text import fold
from statuta.operators.rulebook import RuleBook

SAFETY = "ausnahme_sicherheit_medizin"
EMOTION = "emotionserkennung"


def explicit_or_derived(given: Column, hit: Column) -> Column:
    """The explicit value, else true when the text says so, else unknown."""
    return F.coalesce(given, F.when(hit, True))


def fold_texts(descriptions: DataFrame) -> DataFrame:
    """Adds the folded texts the rules read, each folded once: `_t1` free text, `_t2` with purpose,
    `_t3` with area of use, `_t4` with user group."""
    parts = ["free_text", *K.TEXT_FIELDS]
    joined = [
        fold(F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts[:n]])).alias(f"_t{n}")
        for n in range(1, 5)
    ]
    return descriptions.select("*", *joined)


def with_features(descriptions: DataFrame, book: RuleBook) -> DataFrame:
    """One projection: `_v_<field>` tri-state value and `_d_<field>` (came from the text)."""
    folded = fold_texts(descriptions)
    text = F.col("_t4")
    given = set(descriptions.columns)
    hits = {name: feature_hit(text, phrases) for name, phrases in book.features.items()}
    if EMOTION in hits:
        hits[EMOTION] = hits[EMOTION] & feature_hit(text, book.biometric_carriers)
    names = sorted({*book.known_fields(), *book.condition_fields()})
    derived, values = [], []
    for name in names:
        explicit = F.col(name) if name in given else F.lit(None).cast("boolean")
        if name in hits:
            derived.append((explicit.isNull() & hits[name]).alias(f"_d_{name}"))
        else:
            derived.append(F.lit(False).alias(f"_d_{name}"))
    staged = folded.select(
        "*", *derived, feature_hit(text, book.safety_exception).alias(f"_d_{SAFETY}")
    )
    for name in names:
        explicit = F.col(name) if name in given else F.lit(None).cast("boolean")
        values.append(
            F.coalesce(explicit, F.when(F.col(f"_d_{name}"), True)).alias(f"_v_{name}")
        )
    return staged.select("*", *values)


def value(name: str) -> Column:
    return F.col(f"_v_{name}")


def derived(name: str) -> Column:
    return F.col(f"_d_{name}")
