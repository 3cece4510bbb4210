"""A small rule catalogue whose words occur in the given texts, and a small purpose catalogue."""

from __future__ import annotations

from datetime import date

from statuta.operators.purposes import PurposeLine
from statuta.operators.rulebook import (
    AreaRule,
    Duty,
    ExceptionRule,
    ModelRule,
    PrivacySection,
    ProductRule,
    Prohibition,
    RuleBook,
    TransparencyRule,
)

PERSONAL = "verarbeitet_personenbezogene_daten"
DECIDES = "trifft_entscheidungen_ueber_menschen"

BOOK = RuleBook(
    features={
        "biometrie": ("avec pour", "mit sich"),
        "emotionserkennung": ("that with from", "nicht eine"),
        "erzeugt_inhalte": ("para como",),
        "spricht_mit_menschen": ("this have", "zu den"),
        "grundmodell": ("from that ingtion",),
        PERSONAL: ("sont", "for the"),
        DECIDES: ("dans les", "which"),
        "eingebaut_in_produkt": ("sich nicht", "with"),
        "strafverfolgung": ("esta", "auch"),
    },
    biometric_carriers=("tion", "heit"),
    safety_exception=("nden", "estr"),
    prohibitions=(
        Prohibition("v1", ("emotionserkennung",), exception="medizinisch", basis=("KI-VO/art-5/abs-1",), reason="r1"),
        Prohibition("v2", ("biometrie", DECIDES), required=("qui", "für", "über"), basis=("KI-VO/art-5",), certainty="sicher", reason="r2"),
        Prohibition("v3", ("beeinflusst_verhalten_unterschwellig", PERSONAL), basis=("KI-VO/art-6",), reason="r3"),
    ),
    product=ProductRule("p1", ("produkt_unter_anhang_i", "konformitaetsbewertung_durch_dritte", "eingebaut_in_produkt"),
                        phrases=("that have", "ment"), basis=("KI-VO/art-6/abs-1",), reason="r4"),
    areas=(
        AreaRule("a1", "Arbeit", strong=("nicht", "ther"), phrases=("which that",), basis=("KI-VO/anh-III/nr-4",)),
        AreaRule("a2", "Kredit", phrases=("avec dans sont", "para del"), carriers=("ding", "elle"), actions=("from with", "tion"), basis=("KI-VO/anh-III/nr-5",)),
    ),
    area_relief=("oforly", "erundver"),
    exception=ExceptionRule(
        "h6-3", basis=("KI-VO/art-6/abs-3",), reason="r5",
        cases={"eng": ("erst with",), "vorbereitend": ("sont", "from")},
        no_influence=("that this", "eaux", "nicht eine"), counter_basis=("KI-VO/art-6/abs-3",), counter_reason="r6",
    ),
    transparency=(
        TransparencyRule("t1", ("spricht_mit_menschen",), roles=("anbieter",), basis=("KI-VO/art-50/abs-1",), reason="r7"),
        TransparencyRule("t2", ("erzeugt_inhalte", "biometrie"), any_of_fields=(("erzeugt_inhalte", "oeffentliche_stelle"), ("menschliche_kontrolle",)),
                         basis=("KI-VO/art-50/abs-4",), reason="r8"),
    ),
    model=ModelRule("g1", ("grundmodell",), relief=("thewh",), basis=("KI-VO/art-53",), reason="r9", systemic_basis=("KI-VO/art-51",)),
    minimal_basis=("KI-VO/art-4",),
    minimal_reason="r10",
    duties=(
        Duty("d1", "Kompetenz", "schulen", ("KI-VO/art-4",), citation="Artikel 4 KI-VO"),
        Duty("d2", "Aufsicht", "beaufsichtigen", ("KI-VO/art-14",), citation="Artikel 14 KI-VO", roles=("betreiber",), classes=("hochrisiko_anhang_iii", "hochrisiko_anhang_i")),
        Duty("d3", "Genehmigung", "beantragen", ("KI-VO/art-26",), citation="Artikel 26 KI-VO", only_if_all=("biometrie", "strafverfolgung"), reservation="nur Strafverfolgung"),
        Duty("d4", "Kennzeichnung", "kennzeichnen", ("KI-VO/art-50/abs-2",), citation="Artikel 50 KI-VO", classes=("transparenz", "minimal"), only_if=("erzeugt_inhalte", "spricht_mit_menschen"), severity="hinweis"),
        Duty("d5", "Meldung", "melden", ("KI-VO/art-73",), citation="Artikel 73 KI-VO", roles=("anbieter",), only_if=("oeffentliche_stelle",), if_unknown="weglassen", severity="empfehlung"),
        Duty("d6", "Register", "eintragen", ("KI-VO/art-49",), citation="Artikel 49 KI-VO", classes=("hochrisiko_ausnahme", "verboten"), only_if_all=(PERSONAL,), only_if=("drittlandtransfer",), if_unknown="weglassen", valid_from=date(2026, 8, 2)),
    ),
    privacy=(
        PrivacySection("a-personenbezug", "Personenbezug", "prüfen", ("DSGVO/art-4",), "Artikel 4 DSGVO"),
        PrivacySection("g-automatisierte-entscheidung", "Automatik", "prüfen", ("DSGVO/art-22",), "Artikel 22 DSGVO"),
        PrivacySection("j-datenschutz-durch-technikgestaltung", "Technik", "gestalten", ("DSGVO/art-25",), "Artikel 25 DSGVO"),
        PrivacySection("l-datenschutz-folgenabschaetzung", "Folgen", "abschätzen", ("DSGVO/art-35",), "Artikel 35 DSGVO"),
        PrivacySection("n-datenschutzbeauftragter", "Beauftragte", "benennen", ("BDSG/par-38",), "§ 38 BDSG"),
        PrivacySection("h-auftragsverarbeitung", "Auftrag", "vereinbaren", ("DSGVO/art-28",), "Artikel 28 DSGVO"),
        PrivacySection("x-neu", "Neu", "lesen", ("DSGVO/art-99",), "Artikel 99 DSGVO"),
    ),
    deadlines=((date(2025, 2, 2), "Verbote"), (date(2026, 8, 2), "Hochrisiko")),
    as_of=date(2026, 5, 31),
)

PURPOSES = (
    PurposeLine(0, "the of and in to that with from this have", "KI-VO/anh-III/nr-4-a", "hochrisiko_anhang_iii", "a1"),
    PurposeLine(1, "that which from on for is are", "KI-VO/anh-III/nr-4-b", "hochrisiko_anhang_iii", "a1"),
    PurposeLine(2, "of the in is it", "KI-VO/anh-III/nr-4-b", "hochrisiko_anhang_iii", "a1", counter=True),
    PurposeLine(3, "the on at with the of", "KI-VO/anh-III/nr-4-c", "hochrisiko_anhang_iii", "a1"),
    PurposeLine(4, "de la que el en los", "KI-VO/anh-III/nr-5-a", "hochrisiko_anhang_iii", "a2"),
    PurposeLine(5, "de le la les et dans que", "KI-VO/anh-III/nr-5-b", "hochrisiko_anhang_iii", "a2", required=("est", "Une")),
    PurposeLine(6, "la que un est", "KI-VO/anh-III/nr-5-b", "hochrisiko_anhang_iii", "a2", counter=True),
    PurposeLine(7, "der die und in zu den", "KI-VO/art-5/abs-1-f", "verboten", "v1"),
    PurposeLine(8, "the and of to", "KI-VO/art-5/abs-1-d", "verboten", "v2"),
    PurposeLine(9, "nicht mit sich auf für ist", "KI-VO/art-50/abs-1", "transparenz", "t1"),
    PurposeLine(10, "y que de los del por", "KI-VO/art-50/abs-4", "transparenz", "t2"),
    PurposeLine(11, "und die der", "KI-VO/art-50/abs-4", "transparenz", "t2", counter=True),
)
