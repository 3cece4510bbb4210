"""A second evaluator of the questionnaire, kept for differential checks.

`Walk` reads a case as a plain dictionary and follows the rules one by one; `Walks` follows them for all cases of
an Arrow batch together. The set-based plan must agree with them on every case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.survey import CONDITIONAL, COVERED, EXCLUDED, NEUTRAL, PreRule, Survey


class Walk:
    def __init__(self, survey: Survey, answers: dict[str, str]) -> None:
        self.s, self.a = survey, answers

    def effect(self, q) -> str:
        return {"yes": q.on_yes, "no": q.on_no}.get(self.a.get(q.id), NEUTRAL)

    def denied(self, questions) -> bool:
        return any(self.a.get(q.id) == "no" for q in questions)

    def open(self, questions) -> list:
        return [q for q in questions if q.id not in self.a]

    def truthy(self, questions) -> bool:
        return any(self.a.get(q.id) in ("yes", "na") for q in questions)

    def point(self, p) -> str:
        if self.denied(self.s.blockers(p)) or self.s.compound(p.area):
            return EXCLUDED
        if p.main.id not in self.a:
            return NEUTRAL
        if self.a[p.main.id] == "no" or p.is_gate:
            return EXCLUDED
        effects = {self.effect(q) for q in p.follow_ups}
        if EXCLUDED in effects:
            return EXCLUDED
        if COVERED in effects:
            return COVERED
        return NEUTRAL if self.open(p.follow_ups) else EXCLUDED

    def member(self, p) -> str:
        if p.main.id not in self.a:
            return NEUTRAL
        if self.a[p.main.id] == "no" or EXCLUDED in {self.effect(q) for q in p.follow_ups}:
            return EXCLUDED
        left = bool(self.open(p.follow_ups))
        listed = [q for q in p.follow_ups if q.on_yes == NEUTRAL]
        if listed and not any(self.a.get(q.id) == "yes" for q in listed):
            return NEUTRAL if left else EXCLUDED
        return NEUTRAL if left else COVERED

    def compound(self, c) -> str:
        if self.a.get("bereich:" + c.area) == "no":
            return EXCLUDED
        members = [
            p for p in self.s.points if p.area == c.area and c.special_marker not in p.main.text
        ]
        seen, conditional = [], False
        for p in members:
            verdict = self.member(p)
            mark = c.may_stay_open_marker
            if mark and mark in p.main.text and verdict == EXCLUDED and self.a.get(p.main.id) != "no":
                conditional = True
            else:
                seen.append(verdict)
        if not members or EXCLUDED in seen:
            return EXCLUDED
        if NEUTRAL in seen:
            return NEUTRAL
        return CONDITIONAL if conditional else COVERED

    def product(self) -> tuple[str, list]:
        """Verdict of the product path and the questions it asks next."""
        s = self.s
        if s.annex_gate is None:
            return EXCLUDED, []
        if s.annex_gate.id not in self.a:
            return NEUTRAL, [s.annex_gate]
        if self.a[s.annex_gate.id] == "no":
            return EXCLUDED, []
        kinds = self.open(s.annex_kinds)
        verdict = None
        ask = kinds[:1]
        if not self.truthy(s.annex_kinds):
            return (NEUTRAL if kinds else EXCLUDED), ask
        stopped = bool(ask)
        for g in s.annex_groups:
            own = [[s.annex_questions[k] for k in ks if k in s.annex_questions] for ks in (g.any_of, g.none_of, g.void_if)]
            enough, exclusions, void = own
            if any(self.a.get(q.id) == "yes" for q in void):
                continue
            if self.open(enough):
                verdict = verdict or NEUTRAL
                if not stopped:
                    ask, stopped = self.open(enough)[:1], True
            elif not self.truthy(enough):
                verdict = verdict or EXCLUDED
                stopped = True
            else:
                for q in exclusions:
                    if q.id not in self.a:
                        verdict = verdict or NEUTRAL
                    elif self.truthy([q]):
                        verdict = verdict or EXCLUDED
                if not stopped and self.open(exclusions):
                    ask, stopped = self.open(exclusions)[:1], True
        return verdict or COVERED, ask

    def reached(self) -> list:
        out, shut = [], set()
        for p in self.s.points:
            if p.area in shut or self.denied(self.s.blockers(p)):
                continue
            out.append(p)
            if p.is_gate and self.a.get(p.main.id) == "no":
                shut.add(p.area)
        return out

    def next(self):
        for q in self.s.pre:
            if q.id not in self.a:
                return q
            if self.a[q.id] == "no" and self.s.pre_rules.get(q.id, PreRule()).ends:
                return None
        for q in [*self.product()[1], *self.open(self.s.area_questions)]:
            return q
        for p in self.reached():
            if p.main.id not in self.a:
                return p.main
            if self.a[p.main.id] != "no":
                for q in self.open(p.follow_ups):
                    return q
        holds = any(self.point(p) == COVERED for p in self.s.points) or any(
            self.compound(c) == COVERED for c in self.s.compounds
        )
        if holds:
            for q in self.open(self.s.filters):
                return q
            prof = self.s.profiling
            if prof is not None and self.truthy(self.s.filters) and prof.id not in self.a:
                return prof
        return None

    def sheet(self) -> list:
        first = self.next()
        if first is None:
            return []
        s = self.s
        blocks = [s.pre, [s.annex_gate], s.annex_kinds, list(s.annex_questions.values())]
        blocks += [s.area_questions, s.filters, [s.profiling]]
        blocks += [[p.main for p in self.reached()]] if first in [p.main for p in s.points] else []
        blocks += [p.follow_ups for p in s.points]
        for block in blocks:
            if first in block:
                return self.open([q for q in block if q is not None])
        return [first]

    def finding(self) -> str:
        s = self.s
        if s.pre and self.a.get(s.pre[0].id) == "no":
            return "kein_ki_system"
        if self.product()[0] == COVERED:
            return "hochrisiko_anhang_i"
        areas = [self.compound(c) for c in s.compounds]
        if CONDITIONAL in areas:
            return "hochrisiko_bedingt"
        if COVERED not in areas and not any(self.point(p) == COVERED for p in s.points):
            return "kein_hohes_risiko"
        eased = any(self.a.get(q.id) == "yes" for q in s.filters)
        if eased and s.profiling is not None and self.a.get(s.profiling.id) == "no":
            return "hochrisiko_ausnahme"
        return "hochrisiko_anhang_iii"

    def run(self, pattern: dict[str, str]) -> tuple[int, list[str], str]:
        trace = []
        while sheet := self.sheet():
            trace.append(sheet[0].id)
            self.a.update({q.id: pattern.get(q.id, "no") for q in sheet})
        return len(trace), trace, self.finding()


#: An answer in an array: open, the three answers, and any other value, which is none of them but not open.
OPEN, YES, NO, NA, OTHER = range(5)
#: Bits an answer takes in a packed word, and answers a word.
BITS, PER_WORD = 3, 20


class Walks:
    """The rules of `Walk` for many cases: a row of answers for each question of the path, a column for each case."""

    def __init__(self, survey: Survey, answers: np.ndarray) -> None:
        self.s, self.a = survey, answers
        self.row = {q.id: i for i, q in enumerate(survey.path())}

    def some(self, questions, *codes: int) -> np.ndarray:
        out = np.zeros(self.a.shape[1], bool)
        for q in questions:
            for code in codes:
                out |= self.a[self.row[q.id]] == code
        return out

    def effect(self, questions, wanted: str) -> np.ndarray:
        return self.some([q for q in questions if q.on_yes == wanted], YES) | self.some([q for q in questions if q.on_no == wanted], NO)

    def first_open(self, questions, among: np.ndarray | None = None) -> np.ndarray:
        """Row of the first open question, -1 without one and outside `among`."""
        out = np.full(self.a.shape[1], -1, np.int32)
        for q in reversed(list(questions)):
            out[self.a[self.row[q.id]] == OPEN] = self.row[q.id]
        return out if among is None else np.where(among, out, -1)

    def point(self, p) -> np.ndarray:
        """Covered or not."""
        if p.is_gate or self.s.compound(p.area):
            return np.zeros(self.a.shape[1], bool)
        shut = self.some(self.s.blockers(p), NO) | self.some([p.main], OPEN, NO) | self.effect(p.follow_ups, EXCLUDED)
        return ~shut & self.effect(p.follow_ups, COVERED)

    def compound(self, c) -> tuple[np.ndarray, np.ndarray]:
        """Covered, and covered on condition."""
        excluded = self.some([q for q in self.s.area_questions if q.id == "bereich:" + c.area], NO)
        left, conditional = np.zeros_like(excluded), np.zeros_like(excluded)
        members = [p for p in self.s.points if p.area == c.area and c.special_marker not in p.main.text]
        for p in members:
            unasked, denied, unanswered = self.some([p.main], OPEN), self.some([p.main], NO), self.some(p.follow_ups, OPEN)
            listed = [q for q in p.follow_ups if q.on_yes == NEUTRAL]
            out = denied | self.effect(p.follow_ups, EXCLUDED)
            left |= unasked | (~out & unanswered)
            if listed:
                out |= ~self.some(listed, YES) & ~unanswered
            out &= ~unasked
            if c.may_stay_open_marker and c.may_stay_open_marker in p.main.text:
                conditional |= out & ~denied
                out &= denied
            excluded |= out
        settled = ~excluded & ~left & bool(members)
        return settled & ~conditional, settled & conditional

    def product(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the product path covers, and the row of the question it asks next."""
        s = self.s
        kinds = self.first_open(s.annex_kinds)
        if s.annex_gate is None:
            return np.zeros(len(kinds), bool), np.full_like(kinds, -1)
        named, ask, stopped, failed = self.some(s.annex_kinds, YES, NA), kinds.copy(), kinds >= 0, np.zeros(len(kinds), bool)
        for g in s.annex_groups:
            enough, exclusions, void = [[s.annex_questions[k] for k in ks if k in s.annex_questions] for ks in (g.any_of, g.none_of, g.void_if)]
            counts, unanswered = ~self.some(void, YES), self.some(enough, OPEN)
            short, holds = ~unanswered & ~self.some(enough, YES, NA), ~unanswered & self.some(enough, YES, NA)
            for asked, of in ((counts & unanswered, enough), (counts & holds & self.some(exclusions, OPEN), exclusions)):
                ask = np.where(asked & ~stopped, self.first_open(of), ask)
                stopped = stopped | asked
            stopped |= counts & short
            failed |= counts & (unanswered | short | self.some(exclusions, OPEN, YES, NA))
        ask = np.where(named, ask, kinds)
        gate, denied = self.first_open([s.annex_gate]), self.some([s.annex_gate], NO)
        return (gate < 0) & ~denied & named & ~failed, np.where(gate >= 0, gate, np.where(denied, -1, ask))

    def reached(self) -> list[tuple]:
        """Points with the cases that reach them."""
        out, shut = [], {}
        for p in self.s.points:
            closed = shut.setdefault(p.area, np.zeros(self.a.shape[1], bool))
            here = ~closed & ~self.some(self.s.blockers(p), NO)
            out.append((p, here))
            if p.is_gate:
                closed |= here & self.some([p.main], NO)
        return out

    def next(self) -> np.ndarray:
        """Row of the next question, -1 where all is settled."""
        s = self.s
        found, live = np.full(self.a.shape[1], -1, np.int32), np.ones(self.a.shape[1], bool)

        def ask(rows: np.ndarray) -> None:
            nonlocal found, live
            found = np.where(live & (rows >= 0), rows, found)
            live = live & (rows < 0)

        for q in s.pre:
            ask(self.first_open([q]))
            if s.pre_rules.get(q.id, PreRule()).ends:
                live = live & ~self.some([q], NO)
        ask(self.product()[1])
        ask(self.first_open(s.area_questions))
        for p, here in self.reached():
            ask(self.first_open([p.main], here))
            ask(self.first_open(p.follow_ups, here & ~self.some([p.main], NO)))
        holds = self.holds()
        ask(self.first_open(s.filters, holds))
        if s.profiling is not None:
            ask(self.first_open([s.profiling], holds & self.some(s.filters, YES, NA)))
        return found

    def holds(self) -> np.ndarray:
        tests = [self.point(p) for p in self.s.points] + [self.compound(c)[0] for c in self.s.compounds]
        return np.any(tests, axis=0) if tests else np.zeros(self.a.shape[1], bool)

    def sheet(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of the first question of the sheet (-1 without one), and which questions stand on it."""
        s, following = self.s, self.next()
        blocks = [s.pre, [s.annex_gate], s.annex_kinds, list(s.annex_questions.values()), s.area_questions, s.filters, [s.profiling]]
        blocks = [[(q, True) for q in block if q is not None] for block in blocks]
        blocks.append([(p.main, here) for p, here in self.reached()])
        blocks += [[(q, True) for q in p.follow_ups] for p in s.points]
        first, on, pending = np.full_like(following, -1), np.zeros(self.a.shape, bool), following >= 0
        for block in blocks:
            here = pending & np.isin(following, [self.row[q.id] for q, _ in block])
            pending = pending & ~here
            for q, among in block if here.any() else ():
                row = self.row[q.id]
                on[row] |= here & (self.a[row] == OPEN) & among
                first[on[row] & here & (first < 0)] = row
        rest = np.flatnonzero(pending)
        first[rest], on[following[rest], rest] = following[rest], True
        return first, on

    def finding(self) -> np.ndarray:
        s = self.s
        conditional = [self.compound(c)[1] for c in s.compounds]
        eased = self.some(s.filters, YES) & self.some([s.profiling] if s.profiling else [], NO)
        return np.select(
            [self.some(s.pre[:1], NO), self.product()[0], np.any(conditional, axis=0) if conditional else np.zeros_like(eased), ~self.holds(), eased],
            ["kein_ki_system", "hochrisiko_anhang_i", "hochrisiko_bedingt", "kein_hohes_risiko", "hochrisiko_ausnahme"],
            "hochrisiko_anhang_iii",
        )

    @staticmethod
    def run(survey: Survey, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sheet after sheet → number of sheets, rows of their first questions (a line for each case, then -1), finding.

        A missing answer means No. Settled cases are left out of the following rounds."""
        cases = pattern.shape[1]
        trace, findings = [], np.full(cases, "", object)
        live, rest, given = np.arange(cases), np.where(pattern == OPEN, NO, pattern).astype(np.int8), np.zeros_like(pattern, np.int8)
        while live.size:
            walks = Walks(survey, given)
            first, on = walks.sheet()
            going = first >= 0
            findings[live[~going]] = Walks(survey, given[:, ~going]).finding()
            live, rest = live[going], rest[:, going]
            given = np.where(on[:, going], rest, given[:, going])
            trace.append(np.full(cases, -1, np.int32))
            trace[-1][live] = first[going]
        rows = np.stack(trace, axis=1) if trace else np.zeros((cases, 0), np.int32)
        return (rows >= 0).sum(axis=1), rows, findings


def placed(answers: DataFrame, survey: Survey) -> DataFrame:
    """Answers with their code and its place in the words of a case, for `packed_columns`."""
    rows = [(q.id, i // PER_WORD, i % PER_WORD * BITS) for i, q in enumerate(survey.path())]
    places = answers.sparkSession.createDataFrame(rows, "question_id string, _word int, _shift int")
    code = F.when(F.col("answer") == "yes", YES).when(F.col("answer") == "no", NO).when(F.col("answer") == "na", NA).otherwise(OTHER)
    return answers.join(F.broadcast(places), "question_id", "left").withColumn("_code", code.cast("bigint"))


def packed_columns(survey: Survey) -> list[Column]:
    """Aggregates of a case: how many answers it has, and the words that hold them.

    Words are combined before the shuffle, so a case sends a few numbers and no texts."""
    number = max(1, -(-len(survey.path()) // PER_WORD))
    bits = F.expr("shiftleft(_code, _shift)")
    words = [F.coalesce(F.bit_or(F.when(F.col("_word") == w, bits)), F.lit(0).cast("bigint")) for w in range(number)]
    return [F.count("_word").alias("given"), F.array(*words).alias("words")]


def walk_cases(answers: DataFrame, survey: Survey) -> DataFrame:
    """(case_id, question_id, answer) → (case_id, steps, trace, class), the cases of a batch together.

    A case has at most one row per catalogue question; more are an error.
    """
    return walk_packed(placed(answers, survey).groupBy("case_id").agg(*packed_columns(survey)), survey)


def walk_packed(cases: DataFrame, survey: Survey) -> DataFrame:
    """The same from packed answers (case_id, given, words)."""
    names = [q.id for q in survey.path()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(names, pa.string())
        for batch in batches:
            words = batch.column("words").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            pattern = np.empty((len(names), batch.num_rows), np.int8)
            for i in range(len(names)):
                pattern[i] = words[:, i // PER_WORD] >> (i % PER_WORD * BITS) & (1 << BITS) - 1
            if not np.array_equal((pattern != OPEN).sum(axis=0), batch.column("given").to_numpy()):
                raise ValueError("a case has several answers to one question")
            steps, rows, findings = Walks.run(survey, pattern)
            trace = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(steps)]), pa.int32()), ids.take(pa.array(rows[rows >= 0], pa.int32()))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("case_id"), pa.array(steps, pa.int32()), trace, pa.array(findings, pa.string())], ["case_id", "steps", "trace", "class"]
            )

    kind = cases.schema["case_id"].dataType.simpleString()
    return cases.select("case_id", "given", "words").mapInArrow(run, f"case_id {kind}, steps int, trace array<string>, class string")
