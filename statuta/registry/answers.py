"""Reports, citation checks, measurement, and the end-to-end inquiry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import constants as K
from statuta.operators import diff, measure, quality
from statuta.plans import classify as plan
from statuta.plans import inquiry, report
from statuta.registry import rules as R
from statuta.registry.base import query
from statuta.registry.demo_rules import BOOK
from statuta.registry.frames import UNITS_SQL, as_text, questions, quote, units, values_sql
from statuta.registry.search import HYBRID_CTE
from statuta.registry.text import LABEL_SQL, unit_label
from statuta.session import scratch
from statuta.tables import load

# ---- reports ------------------------------------------------------------------------

REASONS = {p.id: p.reason for p in BOOK.prohibitions} | {p.id + "-ausnahme": p.exception for p in BOOK.prohibitions if p.exception}
REASONS |= {BOOK.product.id: BOOK.product.reason, BOOK.exception.counter_id: BOOK.exception.counter_reason, BOOK.model.id: BOOK.model.reason,
            BOOK.model.systemic_id: "Trainingsaufwand", BOOK.minimal_id: BOOK.minimal_reason}
REASONS |= {a.id: a.title for a in BOOK.areas} | {t.id: t.reason for t in BOOK.transparency}
CASE_NAME = "CASE " + " ".join(
    f"WHEN {R.any_sql([R.phrase_sql('t3', w) for w in ws])} THEN '{name}'" for name, ws in BOOK.exception.cases.items()) + " END"
LABELS = "CASE classes[1] " + " ".join(f"WHEN '{c}' THEN {quote(t)}" for c, t in K.RISK_LABEL.items()) + " END"
OPEN_TEXT = "CASE x " + " ".join(f"WHEN '{c}' THEN {quote('- ' + t)}" for c, t in plan.OPEN_QUESTIONS.items()) + " END"
NL = "chr(10)"
SHEETS = R.DUTIES + R.PRIVACY[len(R.HINTS):] + f""",
{values_sql('reasons', ('rule', 'reason'), list(REASONS.items()))},
{values_sql('dt', ('duty_id', 'action', 'valid_from'), [(d.id, d.action, d.valid_from) for d in BOOK.duties])},
{values_sql('st', ('section', 'title', 'citation', 'action', 'pos'), [(s.id, s.title, s.citation, s.action, i) for i, s in enumerate(BOOK.privacy)])},
hr AS (SELECT h.*, CASE WHEN h.rule = '{BOOK.exception.id}' THEN {CASE_NAME} || ' {BOOK.exception.reason}' ELSE r.reason END AS reason FROM hints h JOIN d2 USING (desc_id) LEFT JOIN reasons r ON r.rule = h.rule),
wh AS (SELECT desc_id, string_agg('- ' || reason || ' [' || certainty || ']', {NL} ORDER BY ord) AS why,
    string_agg('Begründung [' || certainty || ', Regel ' || rule || ']: ' || reason || ' (Fundstellen: ' || coalesce(nullif(replace(basis, '|', ', '), ''), 'keine') || ')', {NL} ORDER BY ord) AS facts FROM hr GROUP BY desc_id),
du AS (SELECT desc_id, string_agg('- ' || title || ' (' || citation || ')' || coalesce(' — gilt ab ' || valid_from, '') || {NL} || '  ' || action, {NL} ORDER BY sev, citation, duty_id) AS duties,
    string_agg('  - ' || title || ' (' || citation || ')' || coalesce(' ab ' || valid_from, '') || ': ' || action, {NL} ORDER BY sev, citation, duty_id) AS duty_facts FROM duty JOIN dt USING (duty_id) GROUP BY desc_id),
pr AS (SELECT desc_id, string_agg('- ' || title || ' (' || citation || ')' || {NL} || '  ' || action, {NL} ORDER BY pos) AS privacy,
    string_agg('  - ' || title || ' (' || citation || '): ' || action, {NL} ORDER BY pos) AS privacy_facts FROM priv JOIN st USING (section) GROUP BY desc_id),
oq AS (SELECT desc_id, {R.OPEN} AS codes FROM full_d),
ol AS (SELECT desc_id, array_to_string(list_transform(string_split(codes, '|'), lambda x: {OPEN_TEXT}), {NL}) AS open_lines FROM oq WHERE codes <> '')"""
JOINED = " FROM full_d JOIN wh USING (desc_id) LEFT JOIN du USING (desc_id) LEFT JOIN pr USING (desc_id) LEFT JOIN ol USING (desc_id)"


@query("e01_report", SHEETS + f""" SELECT desc_id, 'Einstufung: ' || {LABELS} || CASE WHEN len(roles) > 0 THEN {NL} || 'Rolle: ' || array_to_string(list_sort(roles), ', ') ELSE '' END
    || {NL} || {NL} || 'Warum:' || {NL} || why || coalesce({NL} || {NL} || 'Zu tun nach der KI-Verordnung:' || {NL} || duties, '')
    || coalesce({NL} || {NL} || 'Zu tun nach dem Datenschutzrecht:' || {NL} || privacy, '') || coalesce({NL} || {NL} || 'Damit die Auskunft genauer wird:' || {NL} || open_lines, '') AS text{JOINED}""")
def e01(spark, sf):
    return R.classified(spark, sf).select("desc_id", report.report_text().alias("text"))


@query("e02_fact_sheet", SHEETS + f""" SELECT desc_id, 'Risikoklasse: ' || classes[1] || ' — ' || {LABELS} || CASE WHEN len(classes) > 1 THEN {NL} || 'Weitere zutreffende Klassen: ' || array_to_string(classes[2:], ', ') ELSE '' END
    || {NL} || CASE WHEN len(roles) > 0 THEN 'Rolle: ' || array_to_string(list_sort(roles), ', ') ELSE 'Rolle: nicht angegeben — beide Sichten sind dargestellt' END
    || {NL} || facts || coalesce({NL} || 'Pflichten nach der KI-Verordnung:' || {NL} || duty_facts, '') || coalesce({NL} || 'Pflichten nach dem Datenschutzrecht:' || {NL} || privacy_facts, '')
    || coalesce({NL} || 'Offene Fragen:' || {NL} || replace({NL} || open_lines, {NL} || '- ', {NL} || '  - ')[2:], '') AS text{JOINED}""")
def e02(spark, sf):
    return R.classified(spark, sf).select("desc_id", report.fact_sheet().alias("text"))


# conversations: the assistant turn is the answer, user turns of the talk are its evidence
ANSWER = "concat(text, ' Artikel ', CAST(turn + 1 AS STRING), ' Absatz 2, § ', CAST(conv_id % 9 + 1 AS STRING), 'a; Anhang III und Art. ', CAST(conv_id % 50 AS STRING))"
PROOF_TEXT = "concat(text, ' Artikel ', CAST(conv_id % 25 AS STRING), '. § ', CAST(turn + 3 AS STRING), 'a')"
PROOF_KEY = "concat('KI-VO/art-', CAST(turn + 2 AS STRING), CASE WHEN turn % 4 = 0 THEN '/abs-1' ELSE '' END)"
CITES = f"""WITH a AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, {ANSWER} AS text FROM conversations WHERE role = 'assistant'),
    e AS (SELECT a.answer_id, {PROOF_KEY.replace('turn', 'c.turn').replace('conv_id', 'c.conv_id')} AS unit_key, {PROOF_TEXT.replace('text', 'c.text').replace('turn', 'c.turn').replace('conv_id', 'c.conv_id')} AS excerpt
      FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.role = 'user'),
    p AS (SELECT answer_id, unnest(regexp_extract_all(text, '(?:Artikel|Art\\.)\\s*\\d{{1,3}}(?:\\s*Absatz\\s*\\d{{1,2}})?|§\\s*\\d{{1,3}}[a-z]?|Anhang\\s+[IVXLC]+(?:\\s*Nummer\\s*\\d{{1,2}})?')) AS x FROM a),
    m AS (SELECT DISTINCT answer_id, CASE WHEN x LIKE 'Art%' THEN 'art-' || regexp_extract(x, '(\\d+)', 1) WHEN x LIKE '§%' THEN 'par-' || regexp_extract(x, '(\\d+[a-z]?)', 1)
      ELSE 'anh-' || regexp_extract(x, 'Anhang\\s+([IVXLC]+)', 1) END AS mark FROM p),
    al AS (SELECT answer_id, unit_key AS allowed FROM e UNION SELECT answer_id, array_to_string(string_split(unit_key, '/')[1:2], '/') FROM e
      UNION SELECT answer_id, 'art-' || unnest(regexp_extract_all(excerpt || ' ', '(?:Artikel|Art\\.)\\s*(\\d{{1,3}})', 1)) FROM e
      UNION SELECT answer_id, 'par-' || unnest(regexp_extract_all(excerpt || ' ', '§\\s*(\\d{{1,3}}[a-z]?)', 1)) FROM e
      UNION SELECT answer_id, 'anh-' || unnest(regexp_extract_all(excerpt || ' ', 'Anhang\\s+([IVXLC]+)', 1)) FROM e)"""


def answers_and_proof(spark, sf):
    c = load(spark, sf, "conversations")
    a = c.where("role = 'assistant'").selectExpr("conv_id * 100 + turn AS answer_id", "conv_id", f"{ANSWER} AS text")
    e = c.where("role = 'user'").selectExpr("conv_id", f"{PROOF_KEY} AS unit_key", "'' AS citation", f"{PROOF_TEXT} AS excerpt")
    return a.drop("conv_id"), a.select("answer_id", "conv_id").join(e, "conv_id").drop("conv_id")


@query("e04_unsupported_citations", CITES + """ SELECT answer_id, mark FROM m WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.answer_id = m.answer_id
    AND (al.allowed = m.mark OR split_part(al.allowed, '/', 2) = m.mark))""")
def e04(spark, sf):
    return report.unsupported_citations(*answers_and_proof(spark, sf)).select("answer_id", "mark")


@query("e04_unsupported_substring", CITES + " SELECT answer_id, mark FROM m WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.answer_id = m.answer_id AND contains(al.allowed, m.mark))")
def e04_substring(spark, sf):
    return report.unsupported_citations(*answers_and_proof(spark, sf), match="substring").select("answer_id", "mark")


@query("j20_answer_evidence_anti_join", CITES + """ SELECT mark, CAST(count(*) AS BIGINT) AS answers FROM m WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.answer_id = m.answer_id
    AND (al.allowed = m.mark OR split_part(al.allowed, '/', 2) = m.mark)) GROUP BY mark""")
def j20(spark, sf):
    return report.unsupported_citations(*answers_and_proof(spark, sf)).groupBy("mark").agg(F.count(F.lit(1)).alias("answers"))


DUTY_CITES = values_sql("dc", ("duty_id", "cites"), [(d.id, list(dict.fromkeys((*d.basis, *d.also_cited)))) for d in BOOK.duties])


@query("j11_duty_evidence", R.DUTIES + f""", {DUTY_CITES}, u AS (SELECT unit_key, {LABEL_SQL} AS citation FROM ({UNITS_SQL}))
    SELECT duty.desc_id, duty.duty_id, x.unit_key, u.citation FROM duty JOIN (SELECT duty_id, unnest(cites) AS unit_key FROM dc) x USING (duty_id) LEFT JOIN u ON u.unit_key = x.unit_key""")
def j11(spark, sf):
    duties = spark.createDataFrame([(d.id, list(d.basis), list(d.also_cited)) for d in BOOK.duties], "duty_id string, basis array<string>, also_cited array<string>")
    u = units(spark, sf).select("unit_key", unit_label().alias("citation"))
    return report.duty_evidence(R.classified(spark, sf), duties, u, "desc_id").select("desc_id", "duty_id", "unit_key", "citation")


@query("e03_prompt", HYBRID_CTE + """ SELECT query_id, CAST(count(*) AS BIGINT) AS cited, TRUE AS safe, TRUE AS fenced FROM capped GROUP BY query_id""")
def e03(spark, sf):
    """The fence is random, so the comparison is on what must hold for every prompt."""
    from statuta.plans.search import evidence
    from statuta.registry.search import _cut
    from statuta.operators.fusion import cap_cases

    u = units(spark, sf)
    proof = report.evidence_arrays(evidence(cap_cases(_cut(spark, sf), 8), u))
    rows = questions(spark, sf).join(proof, "query_id").withColumn("fence", report.random_fence())
    built = rows.select(
        "query_id", "evidence", "fence", "text",
        report.prompt(F.col("text"), F.col("text"), F.col("evidence"), F.lit("Risikoklasse: minimal"), F.col("fence")).alias("prompt"))
    return built.select(
        "query_id", F.size("evidence").cast("bigint").alias("cited"), report.fence_is_safe(F.col("fence"), F.col("text")).alias("safe"),
        (F.size(F.split("prompt", F.col("fence"))) == 5).alias("fenced"))


def inquiries(spark, sf):
    """Every benchmark question, half of them with a description taken from the talk of that number."""
    c = load(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("inquiry_id"), F.col("text").alias("description"))
    q = questions(spark, sf).select(F.col("query_id").alias("inquiry_id"), F.col("text").alias("question"))
    return q.join(c, "inquiry_id", "left").withColumn("description", F.when(F.col("inquiry_id") % 2 == 0, F.col("description")))


@query("e05_inquiry")
def e05(spark, sf):
    return inquiry.answer(inquiries(spark, sf), units(spark, sf), BOOK).select(
        "inquiry_id", "heaviest", as_text("classes"), "text", as_text("evidence"), "lesson", as_text("cases"))


@query("e05_accepted", """SELECT CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 THEN 'leer' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 2000 THEN 'zu_lang' ELSE 'ok' END AS status, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def e05_accepted(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("inquiry_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("description"))
    return inquiry.accepted(d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- measurement: labels are gold, a rule on the documents is the prediction ------------------

GOLD = "CASE WHEN quality = 1 AND toxic = 0 THEN 'gut' WHEN toxic = 1 THEN 'giftig' ELSE 'schwach' END"
PRED = "CASE WHEN n_chars > 900 THEN 'gut' WHEN doc_id % 13 = 0 THEN 'giftig' ELSE 'schwach' END"
LOG = f"SELECT doc_id AS \"index\", {GOLD} AS soll, {PRED} AS ist, n_chars % 9 AS schritte, CASE WHEN doc_id % 3 = 0 THEN 'unklar' END AS reason FROM labels JOIN documents USING (doc_id)"
AGAIN = f"SELECT doc_id AS \"index\", {GOLD} AS soll, {GOLD} AS ist, n_chars % 5 AS schritte, 'neu' AS reason FROM labels JOIN documents USING (doc_id) WHERE doc_id % 4 = 0"
LOGS = f"WITH log AS ({LOG}), again AS ({AGAIN}), final AS (SELECT * FROM log WHERE \"index\" NOT IN (SELECT \"index\" FROM again) UNION ALL SELECT * FROM again)"


def logs(spark, sf):
    d = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    log = d.selectExpr("doc_id AS index", f"{GOLD} AS soll", f"{PRED} AS ist", "n_chars % 9 AS schritte", "CASE WHEN doc_id % 3 = 0 THEN 'unklar' END AS reason")
    again = d.where("doc_id % 4 = 0").selectExpr("doc_id AS index", f"{GOLD} AS soll", f"{GOLD} AS ist", "n_chars % 5 AS schritte", "'neu' AS reason")
    return log, again


def final_log(spark, sf):
    return diff.overlay(*logs(spark, sf), key="index")


@query("s13_multi_log_scan", LOGS + " SELECT soll, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM log UNION ALL SELECT * FROM again) GROUP BY soll")
def s13(spark, sf):
    """Logs written as JSON arrays, one file per part, and read back together."""
    from statuta.sources.corpus_io import read_logs

    log, again = logs(spark, sf)
    paths = []
    for name, df in (("log", log), ("nach", again)):
        path = scratch(spark, name)
        rows = df.withColumn("schritte", F.col("schritte").cast("int"))
        part = rows.groupBy(F.floor(F.col("index") / 50)).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
        part.select(F.to_json("rows")).write.option("maxRecordsPerFile", 1).text(path)
        paths.append(path)
    return read_logs(spark, paths).groupBy("soll").agg(F.count(F.lit(1)).alias("n"))


@query("j16_overlay", LOGS + " SELECT \"index\", soll, ist, CAST(schritte AS BIGINT) AS schritte, reason FROM final")
def j16(spark, sf):
    return final_log(spark, sf).withColumn("schritte", F.col("schritte").cast("bigint"))


ACCURACY = " SELECT CAST(count(*) FILTER (WHERE soll = ist) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (WHERE soll = ist) / count(*), 4) AS share, round(avg(schritte), 1) AS mean_steps FROM "


@query("a12_accuracy", LOGS + ACCURACY + "log")
def a12(spark, sf):
    return measure.accuracy(logs(spark, sf)[0])


@query("e06_measurement", LOGS + ACCURACY + "final")
def e06(spark, sf):
    return measure.accuracy(final_log(spark, sf))


@query("a12_misses", LOGS + " SELECT \"index\", soll, ist, coalesce(reason, '') AS reason FROM final WHERE soll <> ist")
def a12_misses(spark, sf):
    return measure.misses(final_log(spark, sf))


GOLD_LABELS = ("gut", "giftig", "schwach")


@query("a13_confusion", LOGS + " SELECT soll, " + ", ".join(f"CAST(count(*) FILTER (WHERE ist = '{g}') AS BIGINT) AS ist_{g}" for g in GOLD_LABELS) + " FROM log GROUP BY soll")
def a13(spark, sf):
    return measure.confusion(logs(spark, sf)[0], GOLD_LABELS)


@query("a14_set_accuracy", LOGS + " SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE soll IN (ist, 'gut')) AS BIGINT) AS hits, round(count(*) FILTER (WHERE soll IN (ist, 'gut')) / count(*), 4) AS share, reason FROM log GROUP BY reason")
def a14(spark, sf):
    return measure.set_accuracy(logs(spark, sf)[0], F.col("soll"), F.array("ist", F.lit("gut")), ["reason"])


@query("e07_company_accuracy", R.HINTS + """, x AS (SELECT f.desc_id, array_to_string(list_sort(roles), '|') AS role, classes, CASE desc_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'verboten' ELSE 'hochrisiko_anhang_iii' END AS expected FROM full_d f)
    SELECT role, expected, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE list_contains(classes, expected)) AS BIGINT) AS hits, round(count(*) FILTER (WHERE list_contains(classes, expected)) / count(*), 4) AS share FROM x GROUP BY ALL""")
def e07(spark, sf):
    rows = R.classified(spark, sf).select(
        "classes", F.array_join("roles", "|").alias("role"),
        F.when(F.col("desc_id") % 3 == 0, "minimal").when(F.col("desc_id") % 3 == 1, "verboten").otherwise("hochrisiko_anhang_iii").alias("expected"))
    return measure.set_accuracy(rows, F.col("expected"), F.col("classes"), ["role", "expected"])


@query("v05_gold_coverage", LOGS + """, g AS (SELECT *, soll = ist AS hit FROM log UNION ALL SELECT *, TRUE FROM again WHERE "index" % 40 = 0)
    SELECT 'luecke' AS rule, CAST(i AS VARCHAR) AS subject FROM (SELECT unnest(generate_series(0, (SELECT max("index") FROM g))) AS i) WHERE i NOT IN (SELECT "index" FROM g)
    UNION ALL SELECT 'doppelt', CAST("index" AS VARCHAR) FROM g GROUP BY "index" HAVING count(*) > 1
    UNION ALL SELECT 'ohne_grund', CAST("index" AS VARCHAR) FROM g WHERE NOT hit AND coalesce(reason, '') = ''
    UNION ALL SELECT 'soll_unbekannt', CAST("index" AS VARCHAR) FROM g WHERE soll NOT IN ('gut', 'schwach')""")
def v05(spark, sf):
    log, again = logs(spark, sf)
    gold = log.withColumn("hit", F.col("soll") == F.col("ist")).unionByName(again.where("index % 40 = 0").withColumn("hit", F.lit(True)))
    return quality.coverage_findings(gold, ("gut", "schwach"))


@query("e10_published_numbers", """WITH n AS (SELECT 'documents' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'brands', count(DISTINCT p_brand) FROM part)
    SELECT name, value, expected, value IS NOT DISTINCT FROM expected AS agrees FROM (VALUES ('documents', 1000.0::DOUBLE), ('labels', 399.0), ('brands', 24.0), ('fehlt', 1.0)) e(name, expected) LEFT JOIN n USING (name)""")
def e10(spark, sf):
    found = measure.named_numbers({
        "documents": load(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")), "labels": load(spark, sf, "labels").agg(F.count(F.lit(1)).alias("n")),
        "brands": load(spark, sf, "part").agg(F.count_distinct("p_brand").alias("n"))})
    expected = spark.createDataFrame([("documents", 1000.0), ("labels", 399.0), ("brands", 24.0), ("fehlt", 1.0)], "name string, expected double")
    return measure.check_numbers(found, expected)


# lineitem → two runs over the same steps, apart where the tax is odd
@query("j18_implementation_diff", """WITH a AS (SELECT l_orderkey AS run, l_linenumber AS step, max(l_returnflag) AS v FROM lineitem GROUP BY ALL),
    b AS (SELECT l_orderkey AS run, l_linenumber AS step, max(CASE WHEN l_tax > 0.06 THEN l_linestatus ELSE l_returnflag END) AS v FROM lineitem GROUP BY ALL)
    SELECT run, CAST(min(step) AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS differing FROM a FULL JOIN b USING (run, step) WHERE a.v IS DISTINCT FROM b.v GROUP BY run""")
def j18(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), "l_returnflag", "l_linestatus", "l_tax")
    left = rows.groupBy("run", "step").agg(F.max("l_returnflag").alias("value"))
    right = rows.groupBy("run", "step").agg(F.max(F.when(F.col("l_tax") > 0.06, F.col("l_linestatus")).otherwise(F.col("l_returnflag"))).alias("value"))
    return diff.first_divergence(left, right).withColumn("step", F.col("step").cast("bigint"))
