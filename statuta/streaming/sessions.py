"""Live questionnaires: answers arrive as events, the next sheet or the finding goes out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from statuta.operators.questionnaire_twin import Walk
from statuta.operators.survey import Survey

IDLE_MS = 24 * 3600 * 1000
OUTPUT = "case_id bigint, answered int, sheet array<string>, class string"


def live_questionnaire(answers: DataFrame, survey: Survey, idle_ms: int = IDLE_MS) -> DataFrame:
    """answers (case_id BIGINT, question_id, answer, ts) → one row per case and micro-batch.

    State is a map question → (time, answer), at most one entry per catalogue question; a later
    answer replaces an earlier one, a late-coming older one does not. Idle cases are dropped by a
    processing-time timer.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Session(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.given = handle.getMapState("given", "question_id string", "us bigint, answer string")

        def handleInputRows(self, key, rows, timerValues):
            pdf = pd.concat(list(rows)).sort_values(["us", "answer"])
            for question, us, answer in zip(pdf["question_id"], pdf["us"], pdf["answer"]):
                before = self.given.getValue((question,)) if self.given.containsKey((question,)) else None
                if before is None or before[0] <= us:
                    self.given.updateValue((question,), (int(us), answer))
            walk = Walk(survey, {k[0]: v[1] for k, v in self.given.iterator()})
            sheet = [q.id for q in walk.sheet()]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            yield pd.DataFrame(
                {
                    "case_id": [key[0]],
                    "answered": [len(walk.a)],
                    "sheet": [sheet],
                    "class": ["" if sheet else walk.finding()],
                }
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.given.clear()
            return iter([])

        def close(self) -> None:
            pass

    return answers.groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=Session(), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime"
    )
