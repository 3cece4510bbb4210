"""Ternary questionnaires for a whole table of cases.

A case is three bit sets (yes, no, not applicable) over the catalogue, held in a few BIGINT words.
They come from one aggregation of the answers; every verdict after that is a projection of integer
operations: no join with the catalogue, no row per unanswered question, no second shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import settled
from statuta.functions.tokens import fraction
from statuta.operators.survey import (
    COVERED,
    CONDITIONAL,
    EXCLUDED,
    NEUTRAL,
    SELF_COUNT_STEM,
    Compound,
    Group,
    Point,
    PreRule,
    Question,
    Survey,
)

WORD = 62
KINDS = ("yes", "no", "na")


def drop_self_counting(questions: DataFrame, text: str = "text") -> DataFrame:
    """Without questions that ask about the asker's own earlier answers."""
    return questions.where(~F.startswith(F.lower(F.trim(F.col(text))), F.lit(SELF_COUNT_STEM)))


def latest_answers(answers: DataFrame) -> DataFrame:
    """Last answer per (case, question). Partial maxima are taken before the shuffle, so a case
    with very many repeated answers does not burden one task."""
    return answers.groupBy("case_id", "question_id").agg(
        F.max_by("answer", F.struct("ts", "answer")).alias("answer")
    )


class Compiled:
    """A catalogue compiled to Columns over the state words."""

    def __init__(self, survey: Survey) -> None:
        self.survey = survey
        self.questions = survey.path()
        self.index = {q.id: i for i, q in enumerate(self.questions)}
        self.words = max(1, -(-len(self.questions) // WORD))

    # ---- state ---------------------------------------------------------------

    def state_columns(self) -> list[str]:
        return [f"{k}_{w}" for k in KINDS for w in range(self.words)]

    def state(self, answers: DataFrame, cases: DataFrame | None = None, more: Iterable[Column] = ()) -> DataFrame:
        """answers (case_id, question_id, answer, each pair once) → one row of bit sets per case.

        With `cases` (case_id, ...) every one of them has a row, also without any answer. `more` are further
        aggregates of a case's answers.
        """
        spark = answers.sparkSession
        places = spark.createDataFrame(
            [(q, i // WORD, i % WORD) for q, i in self.index.items()],
            "question_id string, _w int, _b int",
        )
        placed = answers.join(F.broadcast(places), "question_id").withColumn(
            "_bit", F.expr("shiftleft(1L, _b)")
        )
        found = placed.groupBy("case_id").agg(
            *[
                F.coalesce(
                    F.bit_or(F.when((F.col("_w") == w) & (F.col("answer") == k), F.col("_bit"))),
                    F.lit(0).cast("bigint"),
                ).alias(f"{k}_{w}")
                for k in KINDS
                for w in range(self.words)
            ],
            *more,
        )
        if cases is None:
            return found
        return cases.select("case_id").distinct().join(found, "case_id", "left").fillna(0, self.state_columns())

    def random_state(self, cases: DataFrame, seed: int, gate: str | None = None) -> DataFrame:
        return self.state(random_answers(cases, self, seed, gate))

    # ---- bit tests -----------------------------------------------------------

    def _mask(self, questions: Iterable[Question]) -> dict[int, int]:
        out: dict[int, int] = {}
        for q in questions:
            w, b = divmod(self.index[q.id], WORD)
            out[w] = out.get(w, 0) | (1 << b)
        return out

    def _given(self, kinds: tuple[str, ...], w: int) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"{k}_{w}") for k in kinds])

    def any_of(self, questions: Iterable[Question], kinds: tuple[str, ...]) -> Column:
        """Some question has one of these answers."""
        tests = [
            self._given(kinds, w).bitwiseAND(F.lit(m)) != 0
            for w, m in self._mask(questions).items()
        ]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def yes(self, q: Question) -> Column:
        return self.any_of([q], ("yes",))

    def no(self, q: Question) -> Column:
        return self.any_of([q], ("no",))

    def truthy(self, questions: Iterable[Question]) -> Column:
        """Yes and not-applicable both count: the third answer is not a No."""
        return self.any_of(questions, ("yes", "na"))

    def answered(self, q: Question) -> Column:
        return self.any_of([q], KINDS)

    def some_open(self, questions: Iterable[Question]) -> Column:
        """Some question has no answer at all."""
        tests = [
            self._given(KINDS, w).bitwiseAND(F.lit(m)) != F.lit(m)
            for w, m in self._mask(questions).items()
        ]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def open_words(self, questions: Iterable[Question]) -> dict[int, Column]:
        return {
            w: F.lit(m).bitwiseAND(F.bitwise_not(self._given(KINDS, w)))
            for w, m in self._mask(questions).items()
        }

    @staticmethod
    def _lowest(words: dict[int, Column]) -> Column:
        """Index of the lowest set bit over all words, NULL when none is set."""
        out = [
            F.when(x != 0, F.lit(w * WORD) + F.bit_count(x.bitwiseAND(-x) - 1))
            for w, x in sorted(words.items())
        ]
        return F.coalesce(*out) if out else F.lit(None).cast("int")

    def first_open(self, questions: Iterable[Question]) -> Column:
        return self._lowest(self.open_words(list(questions)))

    # ---- verdicts ------------------------------------------------------------

    def consequence(self, questions: Iterable[Question], wanted: str) -> Column:
        """Some answer leads to the wanted consequence, on the Yes or on the No side."""
        questions = list(questions)
        on_yes = [q for q in questions if q.on_yes == wanted]
        on_no = [q for q in questions if q.on_no == wanted]
        return self.any_of(on_yes, ("yes",)) | self.any_of(on_no, ("no",))

    def chain_verdict(self, questions: tuple[Question, ...]) -> Column:
        """Exclusion beats coverage beats open; a chain without questions is excluded."""
        return (
            F.when(self.consequence(questions, EXCLUDED), EXCLUDED)
            .when(self.consequence(questions, COVERED), COVERED)
            .when(self.some_open(questions), NEUTRAL)
            .otherwise(EXCLUDED)
        )

    def blocked(self, point: Point) -> Column:
        return self.any_of(self.survey.blockers(point), ("no",))

    def point_verdict(self, point: Point) -> Column:
        if self.survey.compound(point.area) is not None:
            return F.lit(EXCLUDED)
        opened = F.lit(EXCLUDED) if point.is_gate else self.chain_verdict(point.follow_ups)
        return (
            F.when(self.blocked(point), EXCLUDED)
            .when(~self.answered(point.main), NEUTRAL)
            .when(self.no(point.main), EXCLUDED)
            .otherwise(opened)
        )

    def compound_point(self, point: Point) -> Column:
        listed = [q for q in point.follow_ups if q.on_yes == NEUTRAL]
        unanswered = self.some_open(point.follow_ups)
        verdict = F.when(~self.answered(point.main), NEUTRAL).when(self.no(point.main), EXCLUDED)
        verdict = verdict.when(self.consequence(point.follow_ups, EXCLUDED), EXCLUDED)
        if listed:
            none_holds = ~self.any_of(listed, ("yes",))
            verdict = verdict.when(none_holds & unanswered, NEUTRAL).when(none_holds, EXCLUDED)
        return verdict.when(unanswered, NEUTRAL).otherwise(COVERED)

    def compound_verdict(self, compound: Compound) -> Column:
        members = [p for p in self.survey.points if p.area == compound.area]
        regular = [p for p in members if compound.special_marker not in p.main.text]
        if not regular:
            return F.lit(EXCLUDED)
        choice = [q for q in self.survey.area_questions if q.id == "bereich:" + compound.area]
        excluded, still_open, conditional = [], [], []
        for p in regular:
            verdict = self.compound_point(p)
            mark = compound.may_stay_open_marker
            if mark and mark in p.main.text:
                unknowable = (verdict == EXCLUDED) & ~self.no(p.main)
                conditional.append(unknowable)
                excluded.append((verdict == EXCLUDED) & ~unknowable)
            else:
                excluded.append(verdict == EXCLUDED)
            still_open.append(verdict == NEUTRAL)

        def any_(columns: list[Column]) -> Column:
            return reduce(lambda a, b: a | b, columns, F.lit(False))

        return (
            F.when(self.any_of(choice, ("no",)), EXCLUDED)
            .when(any_(excluded), EXCLUDED)
            .when(any_(still_open), NEUTRAL)
            .when(any_(conditional), CONDITIONAL)
            .otherwise(COVERED)
        )

    def _group(self, group: Group) -> tuple[list[Question], list[Question], list[Question]]:
        ask = self.survey.annex_questions
        return tuple(
            [ask[k] for k in keys if k in ask] for keys in (group.any_of, group.none_of, group.void_if)
        )

    def annex_verdict(self) -> Column:
        """The product path: gate, a product kind, then every group in order."""
        s = self.survey
        if s.annex_gate is None:
            return F.lit(EXCLUDED)
        verdict = (
            F.when(~self.answered(s.annex_gate), NEUTRAL)
            .when(self.no(s.annex_gate), EXCLUDED)
            .when(~self.truthy(s.annex_kinds) & self.some_open(s.annex_kinds), NEUTRAL)
            .when(~self.truthy(s.annex_kinds), EXCLUDED)
        )
        for group in s.annex_groups:
            enough, exclusions, void = self._group(group)
            counts = ~self.any_of(void, ("yes",))
            verdict = verdict.when(counts & self.some_open(enough), NEUTRAL)
            verdict = verdict.when(counts & ~self.truthy(enough), EXCLUDED)
            for q in exclusions:
                verdict = verdict.when(counts & ~self.answered(q), NEUTRAL)
                verdict = verdict.when(counts & self.truthy([q]), EXCLUDED)
        return verdict.otherwise(COVERED)

    # ---- the path ------------------------------------------------------------

    def _reached(self, point: Point) -> Column:
        """Neither blocked nor behind a denied gate of the same area."""
        before = self.survey.points[: self.survey.points.index(point)]
        gates = [p for p in before if p.area == point.area and p.is_gate]
        denied = [self.no(g.main) & ~self.blocked(g) for g in gates]
        return reduce(lambda a, b: a & ~b, denied, ~self.blocked(point))

    def _annex_next(self) -> Column:
        s = self.survey
        none = F.lit(None).cast("int")
        if s.annex_gate is None:
            return none
        rest = none
        for group in reversed(s.annex_groups):
            enough, exclusions, void = self._group(group)
            asked = (
                F.when(self.some_open(enough), self.first_open(enough))
                .when(~self.truthy(enough), none)
                .when(self.some_open(exclusions), self.first_open(exclusions))
                .otherwise(rest)
            )
            rest = F.when(self.any_of(void, ("yes",)), rest).otherwise(asked)
        return (
            F.when(~self.answered(s.annex_gate), F.lit(self.index[s.annex_gate.id]))
            .when(self.no(s.annex_gate), none)
            .when(self.some_open(s.annex_kinds), self.first_open(s.annex_kinds))
            .when(~self.truthy(s.annex_kinds), none)
            .otherwise(rest)
        )

    def _point_words(self, mains_only: bool = False) -> dict[int, Column]:
        """Open bits of every reached point: its main question, or its follow-ups once opened."""
        words: dict[int, Column] = {}
        zero = F.lit(0).cast("bigint")
        for p in self.survey.points:
            reached = self._reached(p)
            asked = {w: F.when(reached, x).otherwise(zero) for w, x in self.open_words([p.main]).items()}
            if not mains_only:
                opened = reached & self.answered(p.main) & ~self.no(p.main)
                for w, x in self.open_words(p.follow_ups).items():
                    follow = F.when(opened, x).otherwise(zero)
                    asked[w] = asked[w].bitwiseOR(follow) if w in asked else follow
            for w, x in asked.items():
                words[w] = words[w].bitwiseOR(x) if w in words else x
        return words

    def something_holds(self) -> Column:
        tests = [self.point_verdict(p) == COVERED for p in self.survey.points]
        tests += [self.compound_verdict(c) == COVERED for c in self.survey.compounds]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def ended(self) -> Column:
        """A pre-question with an ending No was denied before any open pre-question."""
        out = F.lit(False)
        for q in reversed(self.survey.pre):
            ends = self.survey.pre_rules.get(q.id, PreRule()).ends
            stop = self.no(q) if ends else F.lit(False)
            out = F.when(~self.answered(q), False).when(stop, True).otherwise(out)
        return out

    def next_index(self) -> Column:
        """Index of the next open question on the guarded path, NULL when all is settled."""
        s = self.survey
        tail = [self._annex_next(), self.first_open(s.area_questions), self._lowest(self._point_words())]
        if s.filters:
            later = self.first_open(s.filters)
            if s.profiling is not None:
                later = F.coalesce(
                    later,
                    F.when(
                        self.truthy(s.filters) & ~self.answered(s.profiling),
                        F.lit(self.index[s.profiling.id]),
                    ),
                )
            tail.append(F.when(self.something_holds(), later))
        rest = F.coalesce(*tail)
        first = F.lit(None).cast("int")
        for q in reversed(s.pre):
            first = F.when(~self.answered(q), F.lit(self.index[q.id])).otherwise(first)
        return F.when(self.ended(), F.lit(None).cast("int")).otherwise(F.coalesce(first, rest))

    def question_id(self, index: Column) -> Column:
        ids = F.array(*[F.lit(q.id) for q in self.questions])
        return F.try_element_at(ids, index + 1)

    def sheet_words(self, index: Column) -> dict[int, Column]:
        """Bits of all questions on the sheet of the question at `index`."""
        s = self.survey
        zero = F.lit(0).cast("bigint")
        cases: list[tuple[Column, dict[int, Column]]] = []

        def within(questions: Iterable[Question]) -> Column:
            return index.isin(*[self.index[q.id] for q in questions])

        def block(questions: Iterable[Question]) -> None:
            questions = list(questions)
            if questions:
                cases.append((within(questions), self.open_words(questions)))

        block(s.pre)
        block([s.annex_gate] if s.annex_gate else [])
        block(s.annex_kinds)
        block(s.annex_questions.values())
        block(s.area_questions)
        block(s.filters)
        block([s.profiling] if s.profiling else [])
        mains = [p.main for p in s.points]
        if mains:
            cases.append((within(mains), self._point_words(mains_only=True)))
        for p in s.points:
            block(p.follow_ups)
        words = {}
        for w in range(self.words):
            chain = None
            for test, bits in cases:
                value = bits.get(w, zero)
                chain = F.when(test, value) if chain is None else chain.when(test, value)
            words[w] = chain.otherwise(zero) if chain is not None else zero
        return words


def random_answers(cases: DataFrame, compiled: Compiled, seed: int, gate: str | None = None) -> DataFrame:
    """A reproducible answer to every question of the catalogue for every case.

    P(yes) .35, P(no) .50, P(na) .15; the first gate is answered yes with .92.
    """
    ids = F.array(*[F.lit(q.id) for q in compiled.questions])
    rows = cases.select("case_id", F.explode(ids).alias("question_id"))
    gate = gate or (compiled.survey.pre[0].id if compiled.survey.pre else "")
    drawn = rows.select(
        "case_id",
        "question_id",
        fraction(F.lit(seed), F.col("case_id"), F.col("question_id")).alias("_u"),
    )
    u = F.col("_u")
    usual = F.when(u < 0.35, "yes").when(u < 0.85, "no").otherwise("na")
    return drawn.select(
        "case_id",
        "question_id",
        F.when(F.col("question_id") == gate, F.when(u < 0.92, "yes").otherwise("no"))
        .otherwise(usual)
        .alias("answer"),
    )


def verdicts(state: DataFrame, compiled: Compiled) -> DataFrame:
    """State plus one column per point, per compound area and for the product path."""
    s = compiled.survey
    return state.select(
        *state.columns,
        *[compiled.point_verdict(p).alias(f"point_{i}") for i, p in enumerate(s.points)],
        *[compiled.compound_verdict(c).alias(f"compound_{i}") for i, c in enumerate(s.compounds)],
        compiled.annex_verdict().alias("annex"),
    )


def point_table(state: DataFrame, compiled: Compiled) -> DataFrame:
    """(case_id, point, verdict), one row per case and point."""
    rows = F.array(
        *[
            F.struct(F.lit(p.main.id).alias("point"), compiled.point_verdict(p).alias("verdict"))
            for p in compiled.survey.points
        ]
    )
    return state.select("case_id", F.inline(rows))


def findings(state: DataFrame, compiled: Compiled) -> DataFrame:
    """The final finding of every case.

    Priority: not an AI system, product path, conditional compound area (at once), nothing holds,
    exception of the filter, high risk. The wide verdict row is reduced to four arrays first.
    """
    s = compiled.survey
    v = verdicts(state, compiled)

    def keys(of: str) -> Column:
        own = [F.when(F.col(f"point_{i}") == of, F.lit(p.key)) for i, p in enumerate(s.points)]
        return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")

    hits, opened = keys(COVERED), keys(NEUTRAL)
    first_of = {c.area: next((p for p in s.points if p.area == c.area), None) for c in s.compounds}
    conditional = None
    for i, c in enumerate(s.compounds):
        verdict = F.col(f"compound_{i}")
        first = first_of[c.area]
        hits = F.concat(
            hits,
            F.array_compact(F.array(F.when(verdict == COVERED, F.lit(first.key if first else None)))),
        )
        opened = F.concat(opened, F.array_compact(F.array(F.when(verdict == NEUTRAL, F.lit(c.area)))))
        found = F.when(
            verdict == CONDITIONAL,
            F.struct(
                F.lit(first.key if first else None).alias("key"),
                F.lit(c.open_evidence).alias("evidence"),
                F.lit(c.open_text).alias("text"),
            ),
        )
        conditional = found if conditional is None else F.coalesce(conditional, found)
    if conditional is None:
        conditional = F.lit(None).cast("struct<key:string,evidence:string,text:string>")
    kind = F.coalesce(
        *[F.when(compiled.truthy([q]), F.lit(q.title)) for q in s.annex_kinds], F.lit("")
    )
    condition = (
        F.coalesce(
            *[
                F.when(
                    compiled.yes(q),
                    F.struct(F.lit(q.text).alias("text"), F.lit(q.evidence).alias("evidence")),
                )
                for q in s.filters
            ]
        )
        if s.filters
        else F.lit(None).cast("struct<text:string,evidence:string>")
    )
    no_profiling = compiled.no(s.profiling) if s.profiling else F.lit(False)
    not_ai = compiled.no(s.pre[0]) if s.pre else F.lit(False)
    reduced = v.select(
        "case_id",
        not_ai.alias("not_ai"),
        (F.col("annex") == COVERED).alias("product"),
        kind.alias("kind"),
        conditional.alias("conditional"),
        hits.alias("hits"),
        opened.alias("opened"),
        condition.alias("condition"),
        no_profiling.alias("no_profiling"),
    )
    empty = F.array().cast("array<string>")
    klass = (
        F.when(F.col("not_ai"), "kein_ki_system")
        .when(F.col("product"), "hochrisiko_anhang_i")
        .when(F.col("conditional").isNotNull(), "hochrisiko_bedingt")
        .when(F.size("hits") == 0, "kein_hohes_risiko")
        .when(F.col("condition").isNotNull() & F.col("no_profiling"), "hochrisiko_ausnahme")
        .otherwise("hochrisiko_anhang_iii")
    )
    decided = reduced.withColumn("class", settled(klass))
    early = F.col("class").isin("kein_ki_system", "hochrisiko_anhang_i")
    excepted = F.col("class") == "hochrisiko_ausnahme"
    rule = s.pre_rules.get(s.pre[0].id, PreRule()) if s.pre else PreRule()
    by_point = F.create_map(*[F.lit(x) for p in s.points for x in (p.key, p.main.evidence)]) if s.points else None
    gate_evidence = s.annex_gate.evidence if s.annex_gate else ""
    kind_evidence = F.create_map(*[F.lit(x) for q in s.annex_kinds for x in (q.title, q.evidence)]) if s.annex_kinds else None
    evidence = (
        F.when(F.col("not_ai"), F.array(F.lit(s.pre[0].evidence if s.pre else "")))
        .when(
            F.col("class") == "hochrisiko_anhang_i",
            F.filter(
                F.array(F.lit(gate_evidence), kind_evidence[F.col("kind")] if kind_evidence is not None else F.lit("")),
                lambda e: F.length(e) > 0,
            ),
        )
        .when(F.col("class") == "hochrisiko_bedingt", F.array(F.col("conditional.evidence")))
        .when(
            excepted,
            F.array(F.col("condition.evidence"), F.lit(s.profiling.evidence if s.profiling else "")),
        )
        .when(
            F.col("class") == "hochrisiko_anhang_iii",
            F.transform(F.col("hits"), lambda k: by_point[k]) if by_point is not None else empty,
        )
        .otherwise(empty)
    )
    return decided.select(
        "case_id",
        "class",
        F.when(early | (F.col("class") == "kein_hohes_risiko"), empty)
        .when(F.col("class") == "hochrisiko_bedingt", F.array("conditional.key"))
        .otherwise(F.col("hits"))
        .alias("points"),
        excepted.alias("filter_applies"),
        F.when(excepted, F.col("condition.text")).otherwise("").alias("filter_reason"),
        evidence.alias("evidence"),
        F.when(early, empty).otherwise(F.col("opened")).alias("open_points"),
        F.when(F.col("not_ai"), F.lit(rule.end_text))
        .when(F.col("class") == "hochrisiko_bedingt", F.col("conditional.text"))
        .when(F.col("class") == "hochrisiko_anhang_i", F.col("kind"))
        .otherwise("")
        .alias("end_text"),
    )


def next_question(state: DataFrame, compiled: Compiled) -> DataFrame:
    """(case_id, question_id): NULL where everything is settled."""
    return state.select("case_id", compiled.question_id(compiled.next_index()).alias("question_id"))


def next_sheet(state: DataFrame, compiled: Compiled) -> DataFrame:
    """(case_id, sheet): ids of all questions to put together, in path order."""
    indexed = state.withColumn("_next", compiled.next_index())
    words = compiled.sheet_words(F.col("_next"))
    bits = [
        F.when(
            words[i // WORD].bitwiseAND(F.lit(1 << (i % WORD))) != 0, F.lit(q.id)
        )
        for i, q in enumerate(compiled.questions)
    ]
    return indexed.select(
        "case_id",
        F.when(F.col("_next").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array_compact(F.array(*bits)))
        .alias("sheet"),
    )
