"""Driving questionnaires to their end, for all cases together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.operators.questionnaire import KINDS, Compiled
from statuta.session import compiled_methods, cut_lineage

MAX_STEPS = 60


class Step:
    """One round, compiled once: the Columns depend on names only and fit every round's frame."""

    def __init__(self, compiled: Compiled) -> None:
        self.compiled = compiled
        self.next = compiled.next_index()
        self.words = compiled.sheet_words(F.col("_next"))
        self.asked = compiled.question_id(F.col("_next"))

    def advance(self, running: DataFrame) -> DataFrame:
        """Answer the next sheet of every case from its pattern; a missing answer means No."""
        width = range(self.compiled.words)
        sheets = running.withColumn("_next", self.next).select(
            *running.columns,
            F.col("_next"),
            *[
                F.when(F.col("_next").isNull(), F.lit(0).cast("bigint"))
                .otherwise(self.words[w])
                .alias(f"_s{w}")
                for w in width
            ],
        )
        changed = []
        for w in width:
            sheet, yes, na = F.col(f"_s{w}"), F.col(f"p_yes_{w}"), F.col(f"p_na_{w}")
            no = F.bitwise_not(yes.bitwiseOR(na))
            for kind, given in (("yes", yes), ("no", no), ("na", na)):
                name = f"{kind}_{w}"
                changed.append(F.col(name).bitwiseOR(sheet.bitwiseAND(given)).alias(name))
        going = F.col("_next").isNotNull()
        return sheets.select(
            "case_id",
            *[c for c in running.columns if c.startswith("p_")],
            *changed,
            (F.col("steps") + going.cast("int")).alias("steps"),
            F.when(going, F.array_append("trace", self.asked)).otherwise(F.col("trace")).alias("trace"),
            (~going).alias("done"),
        )


def run_to_end(patterns: DataFrame, compiled: Compiled, max_steps: int = MAX_STEPS) -> DataFrame:
    """patterns: state words of the answers each case would give → state at the end, steps, trace.

    All cases advance together by one sheet per round. A round is a narrow projection; the result
    of each round is written to the checkpoint folder, so plans stay short and a lost executor
    costs one round. Finished cases are set aside.
    """
    start = patterns.select(
        "case_id",
        *[F.col(f"{k}_{w}").alias(f"p_{k}_{w}") for k in ("yes", "na") for w in range(compiled.words)],
        *[F.lit(0).cast("bigint").alias(c) for c in compiled.state_columns()],
        F.lit(0).alias("steps"),
        F.array().cast("array<string>").alias("trace"),
        F.lit(False).alias("done"),
    )
    finished: list[DataFrame] = []
    running = cut_lineage(start)
    step = Step(compiled)
    for _ in range(max_steps + 1):
        with compiled_methods(patterns.sparkSession):
            running = cut_lineage(step.advance(running))
        finished.append(running.where("done"))
        running = running.where("NOT done")
        if running.isEmpty():
            break
    else:
        raise RuntimeError(f"questionnaire not settled after {max_steps} sheets")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    keep = [f"{k}_{w}" for k in KINDS for w in range(compiled.words)]
    return out.select("case_id", *keep, "steps", "trace")
