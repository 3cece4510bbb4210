import random

from pyspark.sql import functions as F

from statuta.operators import questionnaire as Q
from statuta.operators.questionnaire_twin import Walk, walk_cases
from statuta.operators.survey import Point, Question, Survey, ordered_follow_ups
from statuta.plans.simulate import run_to_end
from statuta.registry.demo_survey import SURVEY

C = Q.Compiled(SURVEY)


def answers(spark, cases):
    data = [(c, q, a) for c, given in cases.items() for q, a in given.items()]
    return spark.createDataFrame(data, "case_id long, question_id string, answer string")


def random_cases(n, seed=5):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        keep = rng.random() * 0.4 + 0.6
        yes = rng.random()
        pick = lambda: rng.choices(("yes", "no", "na"), (yes, 1 - yes, 0.15))[0]
        out[c] = {q.id: pick() for q in C.questions if rng.random() < keep}
        out[c]["vor:ki"] = "yes" if rng.random() < 0.95 else "no"
    return out


def test_plan_equals_the_per_case_rules(spark):
    cases = random_cases(150)
    state = C.state(answers(spark, cases))
    found = {r["case_id"]: r for r in Q.findings(state, C).collect()}
    ask = {r["case_id"]: r["question_id"] for r in Q.next_question(state, C).collect()}
    sheets = {r["case_id"]: r["sheet"] for r in Q.next_sheet(state, C).collect()}
    for c, given in cases.items():
        w = Walk(SURVEY, dict(given))
        first = w.next()
        assert found[c]["class"] == w.finding(), given
        assert ask[c] == (first.id if first else None), given
        assert set(sheets[c]) == {q.id for q in w.sheet()}, given


def test_runs_agree_step_by_step(spark):
    patterns = Q.random_answers(spark.range(60).withColumnRenamed("id", "case_id"), C, 20261004)
    ours = run_to_end(C.state(patterns), C).select("case_id", "steps", "trace").collect()
    theirs = {r["case_id"]: r for r in walk_cases(patterns, SURVEY).collect()}
    assert len(ours) == 60
    for r in ours:
        assert (r["steps"], r["trace"]) == (theirs[r["case_id"]]["steps"], theirs[r["case_id"]]["trace"])


def test_third_answer_counts_as_yes_for_an_exclusion_but_not_for_void(spark):
    base = {"produkt:tor": "yes", "anhang-i-gattung:maschine": "na", "anhang-i-gattung:spielzeug": "no", "anhang-i-gattung:aufzug": "no",
            "anhang-i:selbst": "no", "anhang-i:teil": "yes", "anhang-i:schutz": "yes", "anhang-i:ausfall": "no", "anhang-i:stelle": "yes", "anhang-i:kontrolle": "no"}
    cases = {1: base | {"anhang-i:komfort": "na"}, 2: base | {"anhang-i:komfort": "no"}, 3: base | {"anhang-i:selbst": "yes"}, 4: base | {"anhang-i:selbst": "na"}}
    got = {r["case_id"]: r["v"] for r in C.state(answers(spark, cases)).select("case_id", C.annex_verdict().alias("v")).collect()}
    assert got == {1: "nicht_erfasst", 2: "erfasst", 3: "erfasst", 4: "weiter"}


def test_point_without_follow_ups_is_excluded_not_open(spark):
    point = Point("p", "a", Question("m"), ())
    c = Q.Compiled(Survey(points=(point,)))
    got = c.state(answers(spark, {1: {"m": "yes"}, 2: {"m": "na"}})).select(c.point_verdict(point).alias("v")).collect()
    assert [r["v"] for r in got] == ["nicht_erfasst"] * 2


def test_more_questions_than_one_word_holds(spark):
    follow = tuple(Question(f"f{i}", on_yes="erfasst" if i == 150 else "weiter") for i in range(200))
    point = Point("p", "a", Question("m"), follow)
    c = Q.Compiled(Survey(points=(point,)))
    given = {"m": "yes"} | {f"f{i}": "no" for i in range(200) if i != 130}
    got = c.state(answers(spark, {1: given | {"f150": "yes"}, 2: given})).select(
        "case_id", c.point_verdict(point).alias("v"), c.question_id(c.next_index()).alias("q")).orderBy("case_id").collect()
    assert [(r["v"], r["q"]) for r in got] == [("erfasst", "f130"), ("weiter", "f130")]


def test_follow_ups_put_facts_first_and_drop_self_counting():
    qs = [Question("x", "a", on_yes="nicht_erfasst"), Question("y", " Haben Sie alle Fragen?"), Question("z", "c")]
    assert [q.id for q in ordered_follow_ups(qs)] == ["z", "x"]


def test_latest_answer_wins(spark):
    rows = spark.createDataFrame([(1, "q", "yes", 1), (1, "q", "no", 3), (1, "q", "na", 2)], "case_id long, question_id string, answer string, ts long")
    assert [r["answer"] for r in Q.latest_answers(rows).select(F.col("answer")).collect()] == ["no"]


def test_batch_rules_equal_the_per_case_rules():
    import numpy as np

    from statuta.operators.questionnaire_twin import NA, NO, OPEN, YES, Walks

    path, codes = SURVEY.path(), {"yes": YES, "no": NO, "na": NA}
    cases = list(random_cases(400, seed=8).values())
    pattern = np.array([[codes.get(given.get(q.id), OPEN) for given in cases] for q in path], np.int8)
    steps, rows, findings = Walks.run(SURVEY, pattern)
    partly = Walks(SURVEY, pattern)
    first, on = partly.sheet()
    now, following = partly.finding(), partly.next()
    for i, given in enumerate(cases):
        walked = (int(steps[i]), [path[r].id for r in rows[i] if r >= 0], findings[i])
        assert walked == Walk(SURVEY, {}).run(dict(given)), given
        w = Walk(SURVEY, dict(given))
        asked, sheet = w.next(), w.sheet()
        assert now[i] == w.finding()
        assert (path[following[i]] if following[i] >= 0 else None) == asked
        assert (path[first[i]] if first[i] >= 0 else None) == (sheet[0] if sheet else None)
        assert {path[r].id for r in np.flatnonzero(on[:, i])} == {q.id for q in sheet}
    assert len(set(findings)) > 3


def test_walked_cases_shuffle_words_and_refuse_two_answers(spark):
    import pytest

    patterns = Q.random_answers(spark.range(20).withColumnRenamed("id", "case_id"), C, 3)
    walked = walk_cases(patterns, SURVEY)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "bit_or" in plan
    twice = patterns.unionByName(patterns.where("case_id = 7 AND question_id = 'vor:ki'"))
    with pytest.raises(Exception, match="several answers"):
        walk_cases(twice, SURVEY).collect()
    other = patterns.withColumn("answer", F.when(F.col("question_id") == "vor:ki", "vielleicht").otherwise(F.col("answer")))
    for r in walk_cases(other, SURVEY).collect():
        given = {x["question_id"]: x["answer"] for x in other.where(F.col("case_id") == r["case_id"]).collect()} if r["case_id"] < 2 else None
        assert given is None or (r["steps"], r["trace"], r["class"]) == Walk(SURVEY, {}).run(given)


def test_two_evaluators_draw_the_patterns_once(spark, monkeypatch):
    from statuta.registry import survey

    drawn, real = [], survey.patterns
    monkeypatch.setattr(survey, "patterns", lambda *a: drawn.append(a) or real(*a))
    got = survey.e08(spark, "/root/testdata/sf0.001").collect()
    assert len(drawn) == 1
    assert [(r["status"], r["cases"]) for r in got] == [("same", 1500)]
