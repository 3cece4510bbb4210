"""Questionnaire queries: every order is a case that answers the catalogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.operators import questionnaire as Q
from statuta.operators.questionnaire_twin import packed_columns, placed, walk_packed
from statuta.plans.simulate import run_to_end
from statuta.registry.base import query
from statuta.registry.demo_survey import SURVEY
from statuta.registry.frames import as_text, fraction_sql, values_sql
from statuta.session import cut_lineage
from statuta.tables import load

C = Q.Compiled(SURVEY)
SEED = 20261004
POS = {q.id: i for i, q in enumerate(C.questions)}


def rows_of(keys, kind):
    return [(g.id, gi, kind, SURVEY.annex_questions[k].id, pos)
            for gi, g in enumerate(SURVEY.annex_groups) for pos, k in enumerate(keys(g))]


CATALOGUE = ",\n".join(
    [
        values_sql("q", ("question_id", "on_yes", "on_no", "pos"),
                   [(q.id, q.on_yes, q.on_no, POS[q.id]) for q in C.questions]),
        values_sql("pts", ("point", "key", "area", "is_gate", "ord", "main_text", "compound"),
                   [(p.main.id, p.key, p.area, p.is_gate, i, p.main.text, SURVEY.compound(p.area) is not None)
                    for i, p in enumerate(SURVEY.points)]),
        values_sql("flw", ("point", "question_id"),
                   [(p.main.id, f.id) for p in SURVEY.points for f in p.follow_ups]),
        values_sql("blocks", ("pre", "key"),
                   [(pre, k) for pre, r in SURVEY.pre_rules.items() if not r.only_addition for k in r.blocks]),
        values_sql("gates", ("area", "gate_key"), list(SURVEY.area_gates.items())),
        values_sql("grp", ("g", "gpos", "kind", "question_id", "pos"),
                   rows_of(lambda g: g.any_of, "any") + rows_of(lambda g: g.none_of, "none")
                   + rows_of(lambda g: g.void_if, "void")),
    ]
)
U, KEEP = fraction_sql(str(SEED), "o_orderkey", "question_id"), fraction_sql("7", "o_orderkey", "question_id")
FULL = f"""full_ans AS MATERIALIZED (SELECT o_orderkey AS case_id, question_id,
    CASE WHEN question_id = 'vor:ki' THEN CASE WHEN {U} < 0.92 THEN 'yes' ELSE 'no' END
      WHEN {U} < 0.35 THEN 'yes' WHEN {U} < 0.85 THEN 'no' ELSE 'na' END AS answer, {KEEP} AS keep FROM orders, q)"""
BASE = f"WITH {CATALOGUE},\n{FULL},\nans AS MATERIALIZED (SELECT case_id, question_id, answer FROM full_ans WHERE keep >= 0.08)"
POINTS = BASE + """,
cp AS (SELECT o_orderkey AS case_id, p.* FROM orders, pts p),
locked AS (SELECT DISTINCT a.case_id, p.point FROM ans a JOIN pts p ON
    (a.question_id = 'bereich:' || p.area
     OR a.question_id IN (SELECT b.pre FROM blocks b WHERE b.key = p.key)
     OR a.question_id IN (SELECT g2.point FROM gates g JOIN pts g2 ON g2.key = g.gate_key WHERE g.area = p.area AND g.gate_key <> p.key))
    WHERE a.answer = 'no'),
fl AS (SELECT a.case_id, f.point, count(*) AS answered,
    bool_or(a.answer = 'yes' AND q.on_yes = 'nicht_erfasst' OR a.answer = 'no' AND q.on_no = 'nicht_erfasst') AS ex,
    bool_or(a.answer = 'yes' AND q.on_yes = 'erfasst' OR a.answer = 'no' AND q.on_no = 'erfasst') AS cov,
    bool_or(a.answer = 'yes' AND q.on_yes = 'weiter') AS listed_yes
    FROM ans a JOIN flw f USING (question_id) JOIN q USING (question_id) GROUP BY a.case_id, f.point),
nf AS (SELECT f.point, count(*) AS n, count(*) FILTER (WHERE q.on_yes = 'weiter') AS listed FROM flw f JOIN q USING (question_id) GROUP BY f.point),
st AS MATERIALIZED (SELECT cp.*, l.point IS NOT NULL AS locked, m.answer AS main, coalesce(fl.ex, FALSE) AS ex, coalesce(fl.cov, FALSE) AS cov,
    coalesce(fl.listed_yes, FALSE) AS listed_yes, coalesce(nf.listed, 0) AS listed, coalesce(fl.answered, 0) < coalesce(nf.n, 0) AS some_open
    FROM cp LEFT JOIN locked l USING (case_id, point) LEFT JOIN ans m ON m.case_id = cp.case_id AND m.question_id = cp.point
    LEFT JOIN fl ON fl.case_id = cp.case_id AND fl.point = cp.point LEFT JOIN nf ON nf.point = cp.point),
chain AS (SELECT *, CASE WHEN ex THEN 'nicht_erfasst' WHEN cov THEN 'erfasst' WHEN some_open THEN 'weiter' ELSE 'nicht_erfasst' END AS chain FROM st),
pv AS MATERIALIZED (SELECT *, CASE WHEN locked OR compound THEN 'nicht_erfasst' WHEN main IS NULL THEN 'weiter' WHEN main = 'no' THEN 'nicht_erfasst'
    WHEN is_gate THEN 'nicht_erfasst' ELSE chain END AS verdict,
    CASE WHEN main IS NULL THEN 'weiter' WHEN main = 'no' OR ex THEN 'nicht_erfasst'
      WHEN listed > 0 AND NOT listed_yes THEN CASE WHEN some_open THEN 'weiter' ELSE 'nicht_erfasst' END
      WHEN some_open THEN 'weiter' ELSE 'erfasst' END AS member FROM chain),
ca AS MATERIALIZED (SELECT p.case_id, CASE WHEN bool_or(z.answer = 'no') THEN 'nicht_erfasst'
      WHEN bool_or(member = 'nicht_erfasst' AND NOT (main_text LIKE '%benannt%' AND main IS DISTINCT FROM 'no')) THEN 'nicht_erfasst'
      WHEN bool_or(member = 'weiter') THEN 'weiter'
      WHEN bool_or(member = 'nicht_erfasst' AND main_text LIKE '%benannt%' AND main IS DISTINCT FROM 'no') THEN 'bedingt' ELSE 'erfasst' END AS verdict
    FROM pv p LEFT JOIN ans z ON z.case_id = p.case_id AND z.question_id = 'bereich:netz'
    WHERE area = 'netz' AND main_text NOT LIKE '%Sonderfall%' GROUP BY p.case_id)"""
ANNEX = """,
gs AS (SELECT c.case_id, g.g, g.gpos,
    bool_or(g.kind = 'void' AND a.answer = 'yes') AS void, bool_or(g.kind = 'any' AND a.answer IS NULL) AS any_open,
    bool_or(g.kind = 'any' AND a.answer IN ('yes', 'na')) AS any_true,
    bool_or(g.kind = 'none' AND a.answer IS NULL) AS none_open, bool_or(g.kind = 'none' AND a.answer IN ('yes', 'na')) AS none_true,
    min(CASE WHEN g.kind = 'any' AND a.answer IS NULL THEN q.pos END) AS any_next, min(CASE WHEN g.kind = 'none' AND a.answer IS NULL THEN q.pos END) AS none_next
    FROM (SELECT o_orderkey AS case_id FROM orders) c CROSS JOIN grp g JOIN q USING (question_id)
    LEFT JOIN ans a ON a.case_id = c.case_id AND a.question_id = g.question_id GROUP BY ALL),
gv AS (SELECT *, CASE WHEN coalesce(void, FALSE) THEN 'pass' WHEN any_open THEN 'weiter' WHEN NOT any_true THEN 'nicht_erfasst'
    WHEN coalesce(none_open, FALSE) THEN 'weiter' WHEN coalesce(none_true, FALSE) THEN 'nicht_erfasst' ELSE 'pass' END AS v,
    CASE WHEN coalesce(void, FALSE) THEN 'pass' WHEN any_open THEN 'ask' WHEN NOT any_true THEN 'stop' WHEN coalesce(none_open, FALSE) THEN 'ask' ELSE 'pass' END AS step FROM gs),
gd AS (SELECT case_id, min_by(v, gpos) FILTER (WHERE v <> 'pass') AS v, min_by(step, gpos) FILTER (WHERE step <> 'pass') AS step,
    min_by(coalesce(any_next, none_next), gpos) FILTER (WHERE step <> 'pass') AS nxt FROM gv GROUP BY case_id),
kd AS (SELECT c.case_id, bool_or(coalesce(a.answer IN ('yes', 'na'), FALSE)) AS any_true, bool_or(a.answer IS NULL) AS some_open,
    min(CASE WHEN a.answer IS NULL THEN q.pos END) AS nxt, min_by(split_part(question_id, ':', 2), q.pos) FILTER (WHERE a.answer IN ('yes', 'na')) AS kind
    FROM (SELECT o_orderkey AS case_id FROM orders) c JOIN q ON q.question_id LIKE 'anhang-i-gattung:%'
    LEFT JOIN ans a USING (case_id, question_id) GROUP BY c.case_id),
ax AS MATERIALIZED (SELECT kd.case_id, kd.kind, CASE WHEN t.answer IS NULL THEN 'weiter' WHEN t.answer = 'no' THEN 'nicht_erfasst'
      WHEN NOT kd.any_true AND kd.some_open THEN 'weiter' WHEN NOT kd.any_true THEN 'nicht_erfasst' ELSE coalesce(gd.v, 'erfasst') END AS verdict,
    CASE WHEN t.answer IS NULL THEN (SELECT pos FROM q WHERE question_id = 'produkt:tor') WHEN t.answer = 'no' THEN NULL
      WHEN kd.some_open THEN kd.nxt WHEN NOT kd.any_true THEN NULL WHEN gd.step = 'ask' THEN gd.nxt END AS nxt
    FROM kd JOIN gd USING (case_id) LEFT JOIN ans t ON t.case_id = kd.case_id AND t.question_id = 'produkt:tor')"""
FINAL = """,
pa AS (SELECT case_id, coalesce(string_agg(key, '|' ORDER BY ord) FILTER (WHERE verdict = 'erfasst'), '') AS hits,
    coalesce(string_agg(key, '|' ORDER BY ord) FILTER (WHERE verdict = 'weiter'), '') AS opened FROM pv GROUP BY case_id),
sa AS (SELECT o_orderkey AS case_id, max(CASE WHEN question_id = 'vor:ki' THEN answer END) AS ki,
    min_by(question_id, pos) FILTER (WHERE question_id LIKE 'filter:%' AND question_id <> 'filter:profiling' AND answer = 'yes') AS cond,
    max(CASE WHEN question_id = 'filter:profiling' THEN answer END) AS prof FROM orders LEFT JOIN ans ON case_id = o_orderkey LEFT JOIN q USING (question_id) GROUP BY o_orderkey),
fin AS MATERIALIZED (SELECT case_id, hits || CASE WHEN ca.verdict = 'erfasst' THEN CASE WHEN hits = '' THEN 'netz' ELSE '|netz' END ELSE '' END AS hits,
    opened || CASE WHEN ca.verdict = 'weiter' THEN CASE WHEN opened = '' THEN 'netz' ELSE '|netz' END ELSE '' END AS opened,
    ki, cond, prof, ax.verdict AS annex, ax.kind, ca.verdict AS comp FROM pa JOIN ca USING (case_id) JOIN ax USING (case_id) JOIN sa USING (case_id)),
fc AS (SELECT *, CASE WHEN ki = 'no' THEN 'kein_ki_system' WHEN annex = 'erfasst' THEN 'hochrisiko_anhang_i' WHEN comp = 'bedingt' THEN 'hochrisiko_bedingt'
    WHEN hits = '' THEN 'kein_hohes_risiko' WHEN cond IS NOT NULL AND prof = 'no' THEN 'hochrisiko_ausnahme' ELSE 'hochrisiko_anhang_iii' END AS class FROM fin)"""
NEXT = """,
reach AS (SELECT p.*, locked OR EXISTS (SELECT 1 FROM st g WHERE g.case_id = p.case_id AND g.area = p.area AND g.is_gate AND g.ord < p.ord
      AND g.main = 'no' AND NOT g.locked) AS shut FROM st p),
pn AS (SELECT case_id, min(pos) AS nxt FROM (
    SELECT r.case_id, q.pos FROM reach r JOIN q ON q.question_id = r.point WHERE NOT shut AND main IS NULL
    UNION ALL SELECT r.case_id, q.pos FROM reach r JOIN flw f USING (point) JOIN q ON q.question_id = f.question_id
      LEFT JOIN ans a ON a.case_id = r.case_id AND a.question_id = f.question_id WHERE NOT shut AND main IS NOT NULL AND main <> 'no' AND a.answer IS NULL)
    GROUP BY case_id),
op AS (SELECT o_orderkey AS case_id, min(CASE WHEN question_id LIKE 'vor:%' AND answer IS NULL THEN pos END) AS pre,
    bool_or(question_id = 'vor:ki' AND coalesce(answer = 'no', FALSE)) AS ended,
    min(CASE WHEN question_id LIKE 'bereich:%' AND answer IS NULL THEN pos END) AS area,
    min(CASE WHEN question_id LIKE 'filter:%' AND question_id <> 'filter:profiling' AND answer IS NULL THEN pos END) AS filt,
    bool_or(question_id LIKE 'filter:%' AND question_id <> 'filter:profiling' AND coalesce(answer IN ('yes', 'na'), FALSE)) AS eased,
    max(CASE WHEN question_id = 'filter:profiling' AND answer IS NULL THEN pos END) AS prof
    FROM orders CROSS JOIN q LEFT JOIN ans ON case_id = o_orderkey AND ans.question_id = q.question_id GROUP BY o_orderkey),
nx AS MATERIALIZED (SELECT op.case_id, CASE WHEN ended THEN NULL ELSE coalesce(pre, ax.nxt, area, pn.nxt,
    CASE WHEN h.holds OR ca.verdict = 'erfasst' THEN coalesce(filt, CASE WHEN eased THEN prof END) END) END AS pos
    FROM op JOIN ax USING (case_id) JOIN ca USING (case_id) LEFT JOIN pn USING (case_id)
    JOIN (SELECT case_id, bool_or(verdict = 'erfasst') AS holds FROM pv GROUP BY case_id) h USING (case_id))"""
NEXT = NEXT.replace("op AS (SELECT o_orderkey AS case_id, min(CASE WHEN question_id", "op AS (SELECT o_orderkey AS case_id, min(CASE WHEN q.question_id")
NEXT = NEXT.replace("bool_or(question_id", "bool_or(q.question_id").replace("WHEN question_id LIKE 'bereich", "WHEN q.question_id LIKE 'bereich")
NEXT = NEXT.replace("WHEN question_id LIKE 'filter:%' AND question_id", "WHEN q.question_id LIKE 'filter:%' AND q.question_id")
NEXT = NEXT.replace("LIKE 'filter:%' AND question_id", "LIKE 'filter:%' AND q.question_id").replace("WHEN question_id = 'filter:profiling'", "WHEN q.question_id = 'filter:profiling'")


def cases(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))


def patterns(spark, sf):
    return Q.random_answers(cases(spark, sf), C, SEED)


def answers(spark, sf):
    from statuta.functions.tokens import fraction

    keep = fraction(F.lit(7), F.col("case_id"), F.col("question_id"))
    return patterns(spark, sf).where(keep >= 0.08)


def state(spark, sf):
    return C.state(answers(spark, sf), cases(spark, sf))


@query("q11_random_patterns", BASE + " SELECT question_id, answer, CAST(count(*) AS BIGINT) AS n, CAST(sum(case_id) AS BIGINT) AS cases FROM full_ans GROUP BY ALL")
def q11(spark, sf):
    return patterns(spark, sf).groupBy("question_id", "answer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("case_id").alias("cases")
    )


@query(
    "q01_consequence",
    BASE
    + """ SELECT CASE answer WHEN 'yes' THEN on_yes WHEN 'no' THEN on_no ELSE 'weiter' END AS effect, question_id, CAST(count(*) AS BIGINT) AS n
    FROM ans JOIN q USING (question_id) GROUP BY ALL""",
)
def q01(spark, sf):
    catalogue = spark.createDataFrame([(q.id, q.on_yes, q.on_no) for q in C.questions], "question_id string, on_yes string, on_no string")
    effect = F.when(F.col("answer") == "yes", F.col("on_yes")).when(F.col("answer") == "no", F.col("on_no")).otherwise("weiter")
    return (
        answers(spark, sf).join(F.broadcast(catalogue), "question_id")
        .groupBy(effect.alias("effect"), "question_id").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "j12_answers_questions",
    BASE + """ SELECT question_id, CAST(count(*) AS BIGINT) AS cases, CAST(count(a.answer) AS BIGINT) AS answered
    FROM (SELECT o_orderkey AS case_id, question_id FROM orders, q) LEFT JOIN ans a USING (case_id, question_id) GROUP BY question_id""",
)
def j12(spark, sf):
    """Unanswered questions survive as the complement of the answered ones: no row per open question."""
    total = cases(spark, sf).agg(F.count(F.lit(1)).alias("cases"))
    given = answers(spark, sf).groupBy("question_id").agg(F.count("answer").alias("answered"))
    catalogue = spark.createDataFrame([(q.id,) for q in C.questions], "question_id string")
    return catalogue.join(F.broadcast(given), "question_id", "left").select(
        "question_id", total.scalar().alias("cases"), F.coalesce("answered", F.lit(0).cast("bigint")).alias("answered")
    )


@query("j13_area_gate", POINTS + """ SELECT point, CAST(count(*) AS BIGINT) AS blocked FROM pts JOIN ans ON ans.answer = 'no'
    AND ans.question_id IN (SELECT g2.point FROM gates g JOIN pts g2 ON g2.key = g.gate_key WHERE g.area = pts.area AND g.gate_key <> pts.key) GROUP BY point""")
def j13(spark, sf):
    rows = F.array_compact(F.array(*[
        F.when(C.no(SURVEY.gate_question(p)), F.lit(p.main.id)) for p in SURVEY.points if SURVEY.gate_question(p) is not None
    ]))
    return state(spark, sf).select(F.explode(rows).alias("point")).groupBy("point").agg(F.count(F.lit(1)).alias("blocked"))


@query("j14_pre_question_block", POINTS + """ SELECT p.point, CAST(count(DISTINCT a.case_id) AS BIGINT) AS blocked FROM pts p JOIN blocks b ON b.key = p.key
    JOIN ans a ON a.question_id = b.pre AND a.answer = 'no' GROUP BY p.point""")
def j14(spark, sf):
    pre = {p.main.id: [q for q in SURVEY.blockers(p) if q in SURVEY.pre] for p in SURVEY.points}
    rows = F.array_compact(F.array(*[F.when(C.any_of(qs, ("no",)), F.lit(name)) for name, qs in pre.items() if qs]))
    return state(spark, sf).select(F.explode(rows).alias("point")).groupBy("point").agg(F.count(F.lit(1)).alias("blocked"))


@query("a05_point_chain", POINTS + " SELECT case_id, point, chain AS verdict FROM chain")
def a05(spark, sf):
    rows = F.array(*[F.struct(F.lit(p.main.id).alias("point"), C.chain_verdict(p.follow_ups).alias("verdict")) for p in SURVEY.points])
    return state(spark, sf).select("case_id", F.inline(rows))


@query("q02_point_verdict", POINTS + " SELECT case_id, point, verdict FROM pv")
def q02(spark, sf):
    return Q.point_table(state(spark, sf), C)


@query("q03_conjunctive_point", POINTS + " SELECT case_id, point, member AS verdict FROM pv WHERE area = 'netz'")
def q03(spark, sf):
    rows = F.array(*[F.struct(F.lit(p.main.id).alias("point"), C.compound_point(p).alias("verdict")) for p in SURVEY.points if p.area == "netz"])
    return state(spark, sf).select("case_id", F.inline(rows))


@query("q04_conjunctive_area", POINTS + " SELECT case_id, verdict FROM ca")
def q04(spark, sf):
    return state(spark, sf).select("case_id", C.compound_verdict(SURVEY.compounds[0]).alias("verdict"))


@query("a06_conjunctive_counts", POINTS + " SELECT verdict, CAST(count(*) AS BIGINT) AS cases FROM ca GROUP BY verdict")
def a06(spark, sf):
    return state(spark, sf).groupBy(C.compound_verdict(SURVEY.compounds[0]).alias("verdict")).agg(F.count(F.lit(1)).alias("cases"))


@query("q05_annex_verdict", BASE + ANNEX + " SELECT case_id, verdict FROM ax")
def q05(spark, sf):
    return state(spark, sf).select("case_id", C.annex_verdict().alias("verdict"))


@query("a07_condition_groups", BASE + ANNEX + " SELECT v AS verdict, g AS group_id, CAST(count(*) AS BIGINT) AS cases FROM gv GROUP BY ALL")
def a07(spark, sf):
    rows = []
    for group in SURVEY.annex_groups:
        enough, exclusions, void = C._group(group)
        verdict = (
            F.when(C.any_of(void, ("yes",)), "pass").when(C.some_open(enough), "weiter").when(~C.truthy(enough), "nicht_erfasst")
            .when(C.some_open(exclusions), "weiter").when(C.truthy(exclusions), "nicht_erfasst").otherwise("pass")
        )
        rows.append(F.struct(verdict.alias("verdict"), F.lit(group.id).alias("group_id")))
    return state(spark, sf).select(F.inline(F.array(*rows))).groupBy("verdict", "group_id").agg(F.count(F.lit(1)).alias("cases"))


@query("w11_first_kind", BASE + ANNEX + " SELECT case_id, kind FROM kd WHERE kind IS NOT NULL")
def w11(spark, sf):
    kind = F.coalesce(*[F.when(C.truthy([q]), F.lit(q.title)) for q in SURVEY.annex_kinds])
    return state(spark, sf).select("case_id", kind.alias("kind")).where("kind IS NOT NULL")


@query(
    "q08_final_finding",
    POINTS + ANNEX + FINAL + """ SELECT case_id, class, CASE WHEN class IN ('kein_ki_system', 'hochrisiko_anhang_i', 'kein_hohes_risiko') THEN ''
      WHEN class = 'hochrisiko_bedingt' THEN 'netz' ELSE hits END AS points, class = 'hochrisiko_ausnahme' AS filter_applies,
      CASE WHEN class = 'hochrisiko_ausnahme' THEN replace(cond, 'filter:', 'nur ') ELSE '' END AS filter_reason,
      CASE class WHEN 'kein_ki_system' THEN 'kein KI-System' WHEN 'hochrisiko_bedingt' THEN 'hängt an der Benennung'
        WHEN 'hochrisiko_anhang_i' THEN kind ELSE '' END AS end_text FROM fc""",
)
def q08(spark, sf):
    return Q.findings(state(spark, sf), C).select("case_id", "class", as_text("points"), "filter_applies", "filter_reason", "end_text")


@query("q09_open_points", POINTS + ANNEX + FINAL + " SELECT case_id, CASE WHEN class IN ('kein_ki_system', 'hochrisiko_anhang_i') THEN '' ELSE opened END AS open_points FROM fc")
def q09(spark, sf):
    return Q.findings(state(spark, sf), C).select("case_id", as_text("open_points"))


@query("w09_next_question_counts", POINTS + ANNEX + NEXT + " SELECT question_id, CAST(count(*) AS BIGINT) AS cases FROM nx LEFT JOIN q USING (pos) GROUP BY question_id")
def w09(spark, sf):
    return Q.next_question(state(spark, sf), C).groupBy("question_id").agg(F.count(F.lit(1)).alias("cases"))


@query("q06_next_question", POINTS + ANNEX + NEXT + " SELECT case_id, question_id FROM nx LEFT JOIN q USING (pos)")
def q06(spark, sf):
    return Q.next_question(state(spark, sf), C)


SHEET = """,
blk AS (SELECT question_id, pos, CASE WHEN question_id LIKE 'vor:%' THEN 'pre' WHEN question_id = 'produkt:tor' THEN 'tor'
    WHEN question_id LIKE 'anhang-i-gattung:%' THEN 'kind' WHEN question_id LIKE 'anhang-i:%' THEN 'annex' WHEN question_id LIKE 'bereich:%' THEN 'area'
    WHEN question_id = 'filter:profiling' THEN 'prof' WHEN question_id LIKE 'filter:%' THEN 'filter' WHEN question_id LIKE 'haupt:%' THEN 'main'
    ELSE replace(regexp_replace(question_id, ':[0-9]+$', ''), 'folge:', 'p:') END AS block FROM q),
sh AS (SELECT nx.case_id, coalesce(string_agg(b2.question_id, '|' ORDER BY b2.pos) FILTER (WHERE a.answer IS NULL AND b2.question_id IS NOT NULL
      AND (b2.block <> 'main' OR r.shut IS FALSE)), '') AS sheet
    FROM nx LEFT JOIN blk b1 ON b1.pos = nx.pos LEFT JOIN blk b2 ON b2.block = b1.block
    LEFT JOIN ans a ON a.case_id = nx.case_id AND a.question_id = b2.question_id
    LEFT JOIN reach r ON r.case_id = nx.case_id AND r.point = b2.question_id GROUP BY nx.case_id)"""


@query("q07_next_sheet", POINTS + ANNEX + NEXT + SHEET + " SELECT case_id, sheet FROM sh")
def q07(spark, sf):
    return Q.next_sheet(state(spark, sf), C).select("case_id", as_text("sheet"))


@query("w10_sheet_sizes", POINTS + ANNEX + NEXT + SHEET + """ SELECT CAST(CASE WHEN sheet = '' THEN 0 ELSE len(string_split(sheet, '|')) END AS BIGINT) AS size,
    CAST(count(*) AS BIGINT) AS cases FROM sh GROUP BY 1""")
def w10(spark, sf):
    return Q.next_sheet(state(spark, sf), C).groupBy(F.size("sheet").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("cases"))


def ended(start):
    """(case_id, steps, trace, class): what belongs to a case passes the findings with its key, so nothing is joined."""
    runs = run_to_end(start, C)
    return Q.findings(runs.withColumn("case_id", F.struct("case_id", "steps", "trace")), C).select("case_id.*", "class")


@query("q10_run_to_end")
def q10(spark, sf):
    """Every order answers sheet after sheet until its finding is settled."""
    return ended(C.state(patterns(spark, sf))).select("case_id", "class", "steps")


@query("e08_two_evaluators")
def e08(spark, sf):
    """Set-based plan and second evaluator on the same patterns: first step that differs, if any.

    A pattern is drawn once; each evaluator has its own packing of it.
    """
    from statuta.operators.diff import compare_runs

    start = cut_lineage(C.state(placed(patterns(spark, sf), SURVEY), more=packed_columns(SURVEY)), "patterns")
    return compare_runs(ended(start), walk_packed(start, SURVEY)).groupBy("status").agg(F.count(F.lit(1)).alias("cases"))


# lineitem → answers that come in over time: the last one per (case, question) counts
@query(
    "w12_latest_answer",
    """SELECT l_orderkey AS case_id, CAST(l_partkey % 5 AS STRING) AS question_id,
    max_by(l_returnflag, (l_shipdate, l_returnflag)) AS answer FROM lineitem GROUP BY ALL""",
)
def w12(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 5).cast("string").alias("question_id"),
        F.col("l_returnflag").alias("answer"), F.col("l_shipdate").alias("ts"),
    )
    return Q.latest_answers(rows)


# part → a catalogue of follow-ups: brand is the point, type says whether it is an exception
@query(
    "w07_facts_before_exceptions",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'ECONOMY', p_partkey) AS pos FROM part""",
)
def w07(spark, sf):
    order = W.partitionBy("p_brand").orderBy(F.col("p_type") == "ECONOMY", "p_partkey")
    return load(spark, sf, "part").select("p_partkey", F.row_number().over(order).cast("bigint").alias("pos"))


@query(
    "w08_point_order",
    """SELECT s_suppkey, n_regionkey AS area_pos, row_number() OVER (PARTITION BY n_regionkey ORDER BY NOT (s_acctbal > 5000), s_name) AS pos
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def w08(spark, sf):
    """Area order, gate first, then key; ordered inside each area so that no task sees all points."""
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("area_pos"))
    order = W.partitionBy("area_pos").orderBy(~(F.col("s_acctbal") > 5000), "s_name")
    return load(spark, sf, "supplier").join(F.broadcast(n), "s_nationkey").select(
        "s_suppkey", "area_pos", F.row_number().over(order).cast("bigint").alias("pos")
    )


@query(
    "a15_catalogue_counts",
    """SELECT p_brand AS point, CAST(count(*) AS BIGINT) AS questions, CAST(count(*) FILTER (WHERE p_type = 'ECONOMY') AS BIGINT) AS exclusions,
    CAST(sum(len(string_split(p_name, ' '))) AS BIGINT) AS examples FROM part GROUP BY p_brand""",
)
def a15(spark, sf):
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("point")).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("p_type") == "ECONOMY").alias("exclusions"),
        F.sum(F.size(F.split("p_name", " "))).alias("examples"),
    )
