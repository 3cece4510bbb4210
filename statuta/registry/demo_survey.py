"""A small question catalogue with every construct: gates, locks, groups, compound area, filter."""

from __future__ import annotations

from statuta.operators.survey import Compound, Group, Point, PreRule, Question, Survey

Y, N, W = "erfasst", "nicht_erfasst", "weiter"


def _point(key: str, area: str, name: str, main: str, *chain: tuple[str, str], gate: bool = False) -> Point:
    """A point whose follow-ups are given as (on_yes, on_no)."""
    return Point(
        key=key,
        area=area,
        main=Question(f"haupt:{name}", main, "punkt", evidence=f"({name})"),
        follow_ups=tuple(
            Question(f"folge:{name}:{i}", f"{name} {i}", "punkt", yes, no, f"({name}.{i})")
            for i, (yes, no) in enumerate(chain)
        ),
        is_gate=gate,
    )


SURVEY = Survey(
    pre=(
        Question("vor:ki", "Leitet das System Ausgaben ab?", "vorfrage", evidence="(1)"),
        Question("vor:personen", "Betrifft es Menschen?", "vorfrage", evidence="(2)"),
        Question("vor:auftrag", "Handelt jemand im Auftrag?", "vorfrage", evidence="(3)"),
    ),
    pre_rules={
        "vor:ki": PreRule(ends=True, end_text="kein KI-System"),
        "vor:personen": PreRule(blocks=("arbeit/a", "arbeit/b", "kredit/a")),
        "vor:auftrag": PreRule(blocks=("kredit/b",), only_addition=True),
    },
    annex_gate=Question("produkt:tor", "Fällt ein Produkt darunter?", "anhang_i", evidence="(10)"),
    annex_kinds=tuple(
        Question(f"anhang-i-gattung:{n}", f"Gattung {n}?", "anhang_i", evidence=f"({i})", title=n)
        for i, n in enumerate(("maschine", "spielzeug", "aufzug"), 11)
    ),
    annex_questions={
        k: Question(f"anhang-i:{k}", k, "anhang_i")
        for k in ("selbst", "teil", "schutz", "ausfall", "komfort", "stelle", "kontrolle", "lieferung")
    },
    annex_groups=(
        Group("rolle", ("selbst", "teil")),
        Group("bauteil", ("schutz", "ausfall"), none_of=("komfort",), void_if=("selbst",)),
        Group("stelle", ("stelle", "kontrolle")),
    ),
    area_questions=tuple(
        Question("bereich:" + a, f"Bereich {a}?", "bereich") for a in ("arbeit", "kredit", "netz")
    ),
    points=(
        _point("arbeit", "arbeit", "arbeit", "Geht es um Arbeit?", (W, W), gate=True),
        _point("arbeit/a", "arbeit", "arbeit-a", "Auswahl?", (Y, W), (W, Y), (N, W)),
        _point("arbeit/b", "arbeit", "arbeit-b", "Steuerung?", (Y, W), (W, N)),
        _point("arbeit/c", "arbeit", "arbeit-c", "Ohne Folgefragen?"),
        _point("kredit/a", "kredit", "kredit-a", "Bonität?", (Y, W), (N, W)),
        _point("kredit/b", "kredit", "kredit-b", "Leistung?", (Y, N), (W, W)),
        _point("netz", "netz", "netz-1", "Versorgungsbereich?", (W, W), (W, W)),
        _point("netz", "netz", "netz-2", "Betreiber förmlich benannt?", (W, N)),
        _point("netz", "netz", "netz-3", "Schutzaufgabe?", (Y, W), (N, W)),
        _point("netz", "netz", "netz-4", "Sonderfall Kernkraft?", (Y, W)),
    ),
    area_gates={"arbeit": "arbeit"},
    compounds=(Compound("netz", "Sonderfall", "benannt", "hängt an der Benennung", "(190)"),),
    filters=tuple(
        Question(f"filter:{n}", f"nur {n}", "filter", evidence=f"({i})")
        for i, n in enumerate(("eng", "verbessernd", "vorbereitend"), 60)
    ),
    profiling=Question("filter:profiling", "Profiling?", "filter", evidence="(69)"),
)
