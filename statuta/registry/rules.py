"""Classification, duty and purpose queries: every document is a description."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta import constants as K
from statuta.operators import duties, features, purposes
from statuta.operators.rulebook import Duty
from statuta.plans import classify as plan
from statuta.registry.base import query
from statuta.registry.demo_rules import BOOK, PURPOSES
from statuta.registry.frames import as_text, bucket_sql, fold_sql, quote, strip_sql, values_sql
from statuta.registry.text import any_sql, feature_sql, phrase_sql, sentences_sql, strong_sql
from statuta.tables import load

FLAGS = (*K.BOOLEAN_FIELDS, *K.EXTRA_BOOLEAN_FIELDS)


def flag_expr(i: int) -> str:
    return f"CASE (doc_id * 7 + {i} * 3) % 11 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"


FLOP = "CASE doc_id % 4 WHEN 0 THEN 2e25 WHEN 1 THEN 1e20 END"
STAFF = "CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 END"


def descriptions(spark, sf):
    d = load(spark, sf, "documents").selectExpr(
        "doc_id AS desc_id", "text AS free_text", "lang AS zweck", "source AS einsatzbereich", "'' AS nutzergruppe",
        *[f"{flag_expr(i)} AS {f}" for i, f in enumerate(FLAGS)],
        f"CAST({FLOP} AS DOUBLE) AS rechenaufwand_flop", f"CAST({STAFF} AS INT) AS anzahl_beschaeftigte",
    )
    roles = F.array_compact(F.array(
        F.when(F.col("desc_id") % 4 >= 2, "betreiber"), F.when(F.col("desc_id") % 2 == 1, "anbieter")))
    return d.withColumn("roles", roles).withColumn("markt", F.lit("EU"))


ROLE_LIST = "list_filter([CASE WHEN doc_id % 4 >= 2 THEN 'betreiber' END, CASE WHEN doc_id % 2 = 1 THEN 'anbieter' END], lambda x: x IS NOT NULL)"
NAMES = sorted({*BOOK.known_fields(), *BOOK.condition_fields()})


def derived_sql(name: str) -> str:
    if name not in BOOK.features:
        return "FALSE"
    hit = any_sql([feature_sql("t4", p) for p in BOOK.features[name]])
    if name == "emotionserkennung":
        hit = f"({hit} AND {any_sql([feature_sql('t4', p) for p in BOOK.biometric_carriers])})"
    return f"(e_{name} IS NULL AND {hit})"


DESC = f"""WITH d0 AS (SELECT doc_id AS desc_id, doc_id, {ROLE_LIST} AS roles, {FLOP} AS flop, {STAFF} AS staff,
    {fold_sql('text')} AS t1, {fold_sql("text || ' ' || lang")} AS t2, {fold_sql("text || ' ' || lang || ' ' || source")} AS t3,
    {fold_sql("text || ' ' || lang || ' ' || source || ' '")} AS t4, {', '.join((flag_expr(FLAGS.index(n)) if n in FLAGS else 'CAST(NULL AS BOOLEAN)') + f' AS e_{n}' for n in NAMES)}
    FROM documents),
d1 AS MATERIALIZED (SELECT *, {', '.join(f'{derived_sql(n)} AS d_{n}' for n in NAMES)}, {any_sql([feature_sql('t4', p) for p in BOOK.safety_exception])} AS d_safety FROM d0),
d2 AS MATERIALIZED (SELECT *, {', '.join(f'coalesce(e_{n}, CASE WHEN d_{n} THEN TRUE END) AS v_{n}' for n in NAMES)} FROM d1)"""


def met_sql(fields) -> str:
    return "(" + " AND ".join(f"coalesce(v_{f}, FALSE)" for f in fields) + ")" if fields else "FALSE"


def basis(items) -> str:
    return quote("|".join(items))


def text_sql(fields) -> str:
    return any_sql([f"d_{f}" for f in fields])


P1, X, M = BOOK.product, BOOK.exception, BOOK.model
bans = []
for i, p in enumerate(BOOK.prohibitions):
    cond = met_sql(p.fields)
    if p.required:
        cond += " AND " + any_sql([f"contains(t2, {fold_sql(quote(w))})" for w in p.required])
    if p.exception:
        bans.append(f"SELECT desc_id, {i} AS ord, 'hochrisiko_anhang_iii' AS class, '{p.id}-ausnahme' AS rule, 'zu_pruefen' AS certainty, {basis((*p.basis, 'KI-VO/anh-III/nr-1'))} AS basis FROM d2 WHERE {cond} AND d_safety")
        cond += " AND NOT d_safety"
    bans.append(f"SELECT desc_id, {i} AS ord, 'verboten' AS class, '{p.id}' AS rule, CASE WHEN {text_sql(p.fields)} THEN 'zu_pruefen' ELSE '{p.certainty}' END AS certainty, {basis(p.basis)} AS basis FROM d2 WHERE {cond}")


def area_hit(a) -> str:
    return any_sql([strong_sql("t4", w) for w in a.strong] + [phrase_sql("t4", w) for w in a.phrases]
                   + ([any_sql([strong_sql("t4", w) for w in a.carriers]) + " AND " + any_sql([phrase_sql("t4", w) for w in a.actions])] if a.carriers else []))


AREAS = " UNION ALL ".join(
    f"SELECT desc_id, {20 + i} AS ord, 'hochrisiko_anhang_iii' AS class, '{a.id}' AS rule, 'zu_pruefen' AS certainty, {basis(a.basis)} AS basis FROM d3 WHERE {area_hit(a)} AND NOT {any_sql([f'contains(t4, {quote(w)})' for w in BOOK.area_relief])}"
    for i, a in enumerate(BOOK.areas))
TRANS = " UNION ALL ".join(
    f"SELECT desc_id, {40 + i} AS ord, 'transparenz' AS class, '{t.id}' AS rule, CASE WHEN {text_sql(t.fields)} THEN 'zu_pruefen' ELSE 'wahrscheinlich' END AS certainty, {basis(t.basis)} AS basis FROM d3 WHERE "
    + any_sql([met_sql(t.fields)] + [met_sql(alt) for alt in t.any_of_fields])
    + (f" AND (len(roles) = 0 OR list_has_any(roles, [{', '.join(quote(r) for r in t.roles)}]))" if t.roles else "")
    for i, t in enumerate(BOOK.transparency))
GPAI = f"{met_sql(M.fields)} AND NOT {any_sql([f'contains(t2, {quote(w)})' for w in M.relief])} AND NOT (list_contains(roles, 'betreiber') AND NOT list_contains(roles, 'anbieter'))"
NOINF = any_sql([phrase_sql("t2", w) for w in X.no_influence])
CASE3 = any_sql([phrase_sql("t3", w) for ws in X.cases.values() for w in ws])
HINTS = DESC + f""",
bans AS MATERIALIZED ({' UNION ALL '.join(bans)}),
d3 AS MATERIALIZED (SELECT * FROM d2 WHERE desc_id NOT IN (SELECT desc_id FROM bans)),
prod AS (SELECT desc_id, 10 AS ord, 'hochrisiko_anhang_i' AS class, '{P1.id}' AS rule, CASE WHEN {met_sql(P1.fields)} THEN 'wahrscheinlich' ELSE 'zu_pruefen' END AS certainty, {basis(P1.basis)} AS basis
  FROM d3 WHERE {met_sql(P1.fields)} OR ({any_sql([phrase_sql('t3', w) for w in P1.phrases])} AND coalesce(v_{P1.carrier_field}, FALSE))),
areas AS MATERIALIZED ({AREAS}),
ex AS MATERIALIZED (SELECT desc_id, 30 AS ord, CASE WHEN coalesce(v_{X.counter_field}, FALSE) AND NOT {NOINF} THEN 'hochrisiko_anhang_iii' ELSE 'hochrisiko_ausnahme' END AS class,
  CASE WHEN coalesce(v_{X.counter_field}, FALSE) AND NOT {NOINF} THEN '{X.counter_id}' ELSE '{X.id}' END AS rule,
  CASE WHEN coalesce(v_{X.counter_field}, FALSE) AND NOT {NOINF} THEN 'wahrscheinlich' ELSE 'zu_pruefen' END AS certainty,
  CASE WHEN coalesce(v_{X.counter_field}, FALSE) AND NOT {NOINF} THEN {basis(X.counter_basis)} ELSE {basis(X.basis)} END AS basis
  FROM d3 WHERE desc_id IN (SELECT desc_id FROM areas) AND ((coalesce(v_{X.counter_field}, FALSE) AND NOT {NOINF}) OR ({CASE3} AND {NOINF}))),
trans AS ({TRANS}),
gpai AS (SELECT desc_id, 50 AS ord, 'gpai' AS class, '{M.id}' AS rule, 'wahrscheinlich' AS certainty, {basis(M.basis)} AS basis FROM d3 WHERE {GPAI}
  UNION ALL SELECT desc_id, 51, 'gpai_systemisch', '{M.systemic_id}', 'wahrscheinlich', {basis(M.systemic_basis)} FROM d3 WHERE {GPAI} AND flop >= 1e25),
found AS MATERIALIZED (SELECT * FROM bans UNION ALL SELECT * FROM prod UNION ALL SELECT * FROM areas WHERE desc_id NOT IN (SELECT desc_id FROM ex WHERE class = 'hochrisiko_ausnahme')
  UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM trans UNION ALL SELECT * FROM gpai),
hints AS MATERIALIZED (SELECT * FROM found UNION ALL SELECT desc_id, 0, 'minimal', '{BOOK.minimal_id}', 'wahrscheinlich', {basis(BOOK.minimal_basis)} FROM d2 WHERE desc_id NOT IN (SELECT desc_id FROM found)),
{values_sql('ranks', ('class', 'rank'), list(K.RISK_RANK.items()))},
cls AS MATERIALIZED (SELECT desc_id, list(class ORDER BY rank) AS classes FROM (SELECT DISTINCT desc_id, class, rank FROM hints JOIN ranks USING (class)) GROUP BY desc_id),
full_d AS MATERIALIZED (SELECT d2.*, cls.classes, CASE WHEN len(roles) = 0 THEN ['anbieter', 'betreiber'] ELSE roles END AS eff FROM d2 JOIN cls USING (desc_id))"""


def hint_rows(spark, sf):
    return plan.hints(descriptions(spark, sf), BOOK)


def classified(spark, sf):
    return plan.classify(descriptions(spark, sf), BOOK)


def stage(name, sql, column):
    """A query over one staged array of hints."""

    @query(name, HINTS + sql)
    def run(spark, sf):
        return hint_rows(spark, sf).select("desc_id", F.explode(column).alias("h")).select(
            "desc_id", "h.class", "h.rule", "h.certainty", F.array_join("h.basis", "|").alias("basis"))


@query("c01_features", DESC + " SELECT desc_id, concat_ws('|', " + ", ".join(f"CASE WHEN d_{n} THEN '{n}' END" for n in NAMES) + ") AS derived, d_safety AS safety FROM d1")
def c01(spark, sf):
    f = features.with_features(descriptions(spark, sf), BOOK)
    return f.select("desc_id", F.concat_ws("|", *[F.when(features.derived(n), F.lit(n)) for n in NAMES]).alias("derived"),
                    F.col(f"_d_{features.SAFETY}").alias("safety"))


COLS = " SELECT desc_id, class, rule, certainty, basis FROM "
one = lambda c: F.array_compact(F.array(c))
stage("c02_prohibitions", COLS + "bans", F.col("_bans"))
stage("c04_product_path", COLS + "prod", one(F.col("_product")))
stage("c05_annex_areas", COLS + "areas", F.col("_areas"))
stage("c06_exception", COLS + "ex", one(F.col("_exception")))
stage("c07_transparency", COLS + "trans", F.col("_transparency"))
stage("c08_general_purpose_models", COLS + "gpai", F.col("_model"))
stage("u04_class_replacement", COLS + "found WHERE ord BETWEEN 20 AND 30 OR class = 'hochrisiko_ausnahme'",
      F.when(F.size("_bans") == 0, F.filter("_found", lambda h: h["class"].isin("hochrisiko_anhang_iii", "hochrisiko_ausnahme"))))


@query("c03_short_circuit", HINTS + """ SELECT desc_id, desc_id IN (SELECT desc_id FROM bans) AS stopped,
    CAST((SELECT count(*) FROM found f WHERE f.desc_id = d2.desc_id AND ord >= 10) AS BIGINT) AS later FROM d2""")
def c03(spark, sf):
    return hint_rows(spark, sf).select(
        "desc_id", (F.size("_bans") > 0).alias("stopped"),
        F.when(F.size("_bans") > 0, 0).otherwise(F.size("_found")).cast("bigint").alias("later"))


@query("c09_default_class", HINTS + " SELECT desc_id, rule FROM hints WHERE class = 'minimal'")
def c09(spark, sf):
    return hint_rows(spark, sf).where(F.size("_found") == 0).select("desc_id", F.element_at("hints", 1)["rule"].alias("rule"))


@query("a08_heaviest_class", HINTS + " SELECT desc_id, classes[1] AS heaviest FROM cls")
def a08(spark, sf):
    return classified(spark, sf).select("desc_id", "heaviest")


@query("a09_sorted_classes", HINTS + " SELECT desc_id, array_to_string(classes, '|') AS classes, array_to_string(list_sort(roles), '|') AS roles FROM cls JOIN d2 USING (desc_id)")
def a09(spark, sf):
    return classified(spark, sf).select("desc_id", as_text("classes"), as_text("roles"))


def gate_sql(d: Duty) -> tuple[str, str]:
    """Case branches for (named, reservation)."""
    named, res = "TRUE", "''"
    if d.only_if:
        some = any_sql([f"coalesce(v_{m}, FALSE)" for m in d.only_if])
        none = "(" + " AND ".join(f"coalesce(NOT v_{m}, FALSE)" for m in d.only_if) + ")"
        named = f"CASE WHEN {some} THEN TRUE WHEN {none} THEN FALSE ELSE {'FALSE' if d.if_unknown == 'weglassen' else 'TRUE'} END"
        res = f"CASE WHEN {some} THEN '' ELSE {quote(d.reservation or 'gilt nur mit ' + ' oder '.join(m.replace('_', ' ') for m in d.only_if))} END"
    if d.only_if_all:
        met = met_sql(d.only_if_all)
        denied = any_sql([f"coalesce(NOT v_{m}, FALSE)" for m in d.only_if_all])
        kept = "FALSE" if d.if_unknown == "weglassen" else f"NOT {denied}"
        named, res = f"CASE WHEN {met} THEN {named} ELSE {kept} END", f"CASE WHEN {met} THEN {res} ELSE {quote(d.reservation)} END"
    return named, res


def lit_list(items) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


DUTIES = HINTS + ",\nduty AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT desc_id, '{d.id}' AS duty_id, {K.SEVERITY_RANK[d.severity]} AS sev, {quote(d.citation)} AS citation, {quote(d.title)} AS title, {gate_sql(d)[1]} AS reservation FROM full_d WHERE {gate_sql(d)[0]}"
    + (f" AND list_has_any(classes, {lit_list(d.classes)})" if d.classes else "")
    + (f" AND list_has_any(eff, {lit_list(d.roles)})" if d.roles else "")
    for d in BOOK.duties) + ")"


@query("c10_duty_features", DESC + " SELECT desc_id, " + ", ".join(f"{gate_sql(d)[0]} AS {d.id}, {gate_sql(d)[1]} AS {d.id}_reservation" for d in BOOK.duties) + " FROM d2")
def c10(spark, sf):
    f = features.with_features(descriptions(spark, sf), BOOK)
    cols = []
    for d in BOOK.duties:
        named, reservation = duties.feature_gate(d)
        cols += [named.alias(d.id), reservation.alias(d.id + "_reservation")]
    return f.select("desc_id", *cols)


@query("c11_duties", DUTIES + " SELECT desc_id, duty_id, reservation FROM duty")
def c11(spark, sf):
    return classified(spark, sf).select("desc_id", F.explode("duties").alias("d")).select(
        "desc_id", F.col("d.id").alias("duty_id"), "d.reservation")


@query("t05_duty_order", DUTIES + " SELECT desc_id, string_agg(duty_id, '|' ORDER BY sev, citation, duty_id) AS duties FROM duty GROUP BY desc_id")
def t05(spark, sf):
    return classified(spark, sf).select(
        "desc_id", F.array_join(F.transform("duties", lambda d: d["id"]), "|").alias("duties")).where("duties <> ''")


def privacy_sql(name: str) -> str:
    return {
        "hohes_risiko": f"list_has_any(classes, {lit_list(K.HIGH_RISK)})",
        "viele_beschaeftigte": "coalesce(staff >= 20, FALSE)",
        "zugekauft": any_sql([f"contains(t1, {quote(w)})" for w in K.PURCHASED_PHRASES]),
        "eigenentwicklung": "list_contains(roles, 'anbieter')",
    }.get(name, f"coalesce(v_{name}, FALSE)")


PRIVACY = HINTS + ",\npriv AS (" + " UNION ALL ".join(
    f"SELECT desc_id, '{s.id}' AS section FROM full_d WHERE coalesce(v_verarbeitet_personenbezogene_daten, TRUE)"
    + "".join(f" AND {privacy_sql(c)}" for c in K.PRIVACY_CONDITIONS.get(s.id, ())) for s in BOOK.privacy) + ")"


@query("c12_privacy_path", PRIVACY + " SELECT desc_id, section FROM priv")
def c12(spark, sf):
    return classified(spark, sf).select("desc_id", F.explode("privacy").alias("s")).select("desc_id", F.col("s.id").alias("section"))


FILLED = " + ".join([f"(CASE WHEN {flag_expr(i)} IS NOT NULL THEN 1 ELSE 0 END)" for i in range(len(FLAGS))]
                    + ["2", "(CASE WHEN flop IS NOT NULL THEN 1 ELSE 0 END)", "(CASE WHEN staff IS NOT NULL THEN 1 ELSE 0 END)", "(CASE WHEN len(roles) > 0 THEN 1 ELSE 0 END)"])
OPEN = f"""concat_ws('|', CASE WHEN len(roles) = 0 THEN 'rolle' END, CASE WHEN v_verarbeitet_personenbezogene_daten IS NULL THEN 'personenbezug' END,
    CASE WHEN list_contains(classes, 'hochrisiko_anhang_iii') AND v_menschliche_kontrolle IS NULL THEN 'kontrolle' END,
    CASE WHEN list_contains(classes, 'hochrisiko_anhang_iii') AND v_trifft_entscheidungen_ueber_menschen IS NULL THEN 'profiling' END,
    CASE WHEN list_contains(classes, 'gpai') AND flop IS NULL THEN 'rechenaufwand' END, CASE WHEN {FILLED} < 3 THEN 'duenn' END)"""


@query("c13_open_questions", HINTS + f" SELECT desc_id, {OPEN} AS open_questions FROM full_d")
def c13(spark, sf):
    return classified(spark, sf).select("desc_id", as_text("open_questions"))


@query("c14_full_classification", DUTIES + f""" SELECT f.desc_id, classes[1] AS heaviest, array_to_string(classes, '|') AS classes, h.rules, coalesce(x.duties, '') AS duties,
    {OPEN} AS open_questions, '2026-05-31' AS as_of FROM full_d f
    JOIN (SELECT desc_id, string_agg(rule, '|' ORDER BY ord) AS rules FROM hints GROUP BY desc_id) h USING (desc_id)
    LEFT JOIN (SELECT desc_id, string_agg(duty_id, '|' ORDER BY sev, citation, duty_id) AS duties FROM duty GROUP BY desc_id) x USING (desc_id)""")
def c14(spark, sf):
    return classified(spark, sf).select(
        "desc_id", "heaviest", as_text("classes"), F.array_join(F.transform("hints", lambda h: h["rule"]), "|").alias("rules"),
        F.array_join(F.transform("duties", lambda d: d["id"]), "|").alias("duties"), as_text("open_questions"), F.col("as_of").cast("string").alias("as_of"))


@query("u03_basis_union", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag IN (l_linestatus, 'A') THEN concat_ws('|', l_linestatus, 'A')
    ELSE concat_ws('|', l_returnflag, l_linestatus, 'A') END AS basis FROM lineitem""")
def u03(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(
        plan.prepend_basis(F.col("l_returnflag"), F.array("l_linestatus", F.lit("A"))), "|").alias("basis"))


# part → duties, orders → described cases: classes and roles that both sides may leave open
PART_CLASSES = "CASE WHEN p_size % 4 = 0 THEN 'N' ELSE p_type END"


@query("j10_class_role_duty", """WITH c AS (SELECT o_orderkey, ['ECONOMY', CASE o_orderstatus WHEN 'F' THEN 'PROMO' ELSE 'SMALL' END] AS cls,
      [substr(o_orderpriority, 1, 1)] AS roles FROM orders),
    d AS (SELECT DISTINCT p_brand AS duty, CASE WHEN p_size % 4 = 0 THEN [] ELSE [p_type] END AS cls, CASE WHEN p_size % 3 = 0 THEN [] ELSE [CAST(p_size % 7 AS VARCHAR)] END AS roles FROM part),
    m AS (SELECT DISTINCT o_orderkey, duty FROM c, d WHERE (len(d.cls) = 0 OR list_has_any(c.cls, d.cls)) AND (len(d.roles) = 0 OR list_has_any(c.roles, d.roles)))
    SELECT o_orderkey, CAST(count(*) AS BIGINT) AS duties, min(duty) AS first_duty FROM m GROUP BY o_orderkey""")
def j10(spark, sf):
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.array(F.lit("ECONOMY"), F.when(F.col("o_orderstatus") == "F", "PROMO").otherwise("SMALL")).alias("classes"),
        F.array(F.substring("o_orderpriority", 1, 1)).alias("effective_roles"))
    empty = F.array().cast("array<string>")
    p = load(spark, sf, "part").select(
        F.col("p_brand").alias("duty_id"),
        F.when(F.col("p_size") % 4 == 0, empty).otherwise(F.array("p_type")).alias("classes"),
        F.when(F.col("p_size") % 3 == 0, empty).otherwise(F.array((F.col("p_size") % 7).cast("string"))).alias("roles")).distinct()
    return duties.match_duties(o, p, "o_orderkey").groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("duties"), F.min("duty_id").alias("first_duty"))


@query("c16_penalties", """SELECT c_custkey, round(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN least(50.0 * (c_nationkey % 3 + 1), c_acctbal * (c_nationkey % 3 + 1) / 100)
    ELSE greatest(50.0 * (c_nationkey % 3 + 1), c_acctbal * (c_nationkey % 3 + 1) / 100) END, 6) AS penalty FROM customer""")
def c16(spark, sf):
    tiers = spark.createDataFrame([(i, 50.0 * (i + 1), float(i + 1)) for i in range(3)], "tier int, cap_eur double, cap_pct double")
    c = load(spark, sf, "customer").withColumn("tier", (F.col("c_nationkey") % 3).cast("int"))
    return c.join(F.broadcast(tiers), "tier").select("c_custkey", F.round(
        duties.penalty(F.col("c_acctbal"), F.col("cap_eur"), F.col("cap_pct"), F.col("c_mktsegment") == "HOUSEHOLD"), 6).alias("penalty"))


# ---- purposes ------------------------------------------------------------------

LINES = values_sql("pl", ("line_id", "purpose", "unit_key", "class", "rule", "counter", "required"),
                   [(p.id, p.text, p.key, p.klass, p.rule, p.counter, [w.lower() for w in p.required]) for p in PURPOSES])
PAIRS = f"""WITH {LINES}, {sentences_sql('doc_id', 'documents')},
sent AS MATERIALIZED (SELECT doc_id AS desc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_no FROM (
    SELECT doc_id, list_filter(s, lambda x, i: i <= len_k OR NOT list_contains(s[1:len_k], x)) AS s FROM (SELECT a.doc_id, a.s, len(k.k) AS len_k FROM all_s a JOIN kept_s k USING (doc_id)))),
sb AS (SELECT desc_id, sentence_no, {bucket_sql('w')} AS b, count(*) AS n FROM (SELECT desc_id, sentence_no,
    unnest(list_filter(regexp_split_to_array(lower(sentence), '\\s+'), lambda x: length(x) > 0)) AS w FROM sent) GROUP BY ALL),
sn AS MATERIALIZED (SELECT desc_id, sentence_no, b, n, sqrt(sum(n * n) OVER (PARTITION BY desc_id, sentence_no)) AS norm FROM sb),
pb AS (SELECT line_id, {bucket_sql('w')} AS b, count(*) AS n FROM (SELECT line_id, unnest(string_split(lower(purpose), ' ')) AS w FROM pl) GROUP BY ALL),
pn AS (SELECT line_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY line_id)) AS x FROM pb),
sim0 AS MATERIALIZED (SELECT desc_id, sentence_no, line_id, round(sum(sn.n * pn.x) / any_value(norm), 9) AS sim FROM sn JOIN pn USING (b) GROUP BY ALL),
sim AS MATERIALIZED (SELECT s.desc_id, s.sentence_no, p.line_id, p.unit_key, p.rule, coalesce(z.sim, 0) AS sim FROM sent s CROSS JOIN pl p
    LEFT JOIN sim0 z ON z.desc_id = s.desc_id AND z.sentence_no = s.sentence_no AND z.line_id = p.line_id),
bk AS (SELECT desc_id, sentence_no, unit_key, any_value(rule) AS rule, max(sim) AS sim, arg_min(line_id, (-sim, line_id)) AS line_id FROM sim GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY desc_id, sentence_no, rule ORDER BY sim DESC, line_id) AS r1 FROM bk),
kk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY desc_id, sentence_no ORDER BY sim DESC, line_id) AS r2 FROM rr WHERE r1 <= 2),
pairs AS MATERIALIZED (SELECT s.desc_id, s.sentence_no, s.line_id, s.sim FROM sim s JOIN kk USING (desc_id, sentence_no, unit_key) WHERE r2 <= 5)"""
DECIDE = PAIRS + """,
nm AS MATERIALIZED (SELECT p.*, l.unit_key, l.class, l.rule, l.counter, l.required, l.purpose, s.sentence FROM pairs p JOIN pl l USING (line_id) JOIN sent s USING (desc_id, sentence_no)),
bb AS MATERIALIZED (SELECT * FROM nm WHERE NOT counter QUALIFY row_number() OVER (PARTITION BY desc_id, unit_key ORDER BY sim DESC, sentence_no, line_id) = 1),
cc AS MATERIALIZED (SELECT desc_id, rule, max(sim) AS cv FROM nm WHERE counter GROUP BY ALL),
ss AS (SELECT desc_id, max(CASE WHEN cv >= 0.90 THEN cv END) AS strong FROM cc GROUP BY desc_id),
hit AS MATERIALIZED (SELECT bb.*, row_number() OVER (PARTITION BY bb.desc_id ORDER BY sim DESC, unit_key) AS place
    FROM bb LEFT JOIN cc ON cc.desc_id = bb.desc_id AND cc.rule = bb.rule LEFT JOIN ss ON ss.desc_id = bb.desc_id JOIN documents d ON d.doc_id = bb.desc_id
    WHERE sim >= CASE WHEN class = 'verboten' THEN 0.85 ELSE 0.5 END AND sim > greatest(coalesce(cv, -1), coalesce(strong, 0))
      AND (len(required) = 0 OR len(list_filter(required, lambda w: contains(lower(d.text), w))) > 0)
    QUALIFY place <= 4)"""


def sentence_rows(spark, sf):
    return purposes.sentence_table(load(spark, sf, "documents").withColumnRenamed("doc_id", "desc_id"), "desc_id", "text")


def pair_rows(spark, sf):
    return purposes.candidate_pairs(sentence_rows(spark, sf), PURPOSES, "desc_id")


def hits(spark, sf):
    d = load(spark, sf, "documents").withColumnRenamed("doc_id", "desc_id")
    scored = purposes.score_pairs(pair_rows(spark, sf), PURPOSES, None)
    return purposes.decide(scored, PURPOSES, d, "desc_id", "text")


@query("z01_purpose_sentences", PAIRS + " SELECT desc_id, CAST(sentence_no AS BIGINT) AS sentence_no, sentence FROM sent")
def z01(spark, sf):
    return sentence_rows(spark, sf).withColumn("sentence_no", F.col("sentence_no").cast("bigint"))


@query("z02_candidate_pairs", PAIRS + " SELECT desc_id, CAST(sentence_no AS BIGINT) AS sentence_no, CAST(line_id AS BIGINT) AS line_id, round(sim, 4) AS similarity FROM pairs")
def z02(spark, sf):
    return pair_rows(spark, sf).select("desc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), F.col("line_id").cast("bigint").alias("line_id"), F.round("similarity", 4).alias("similarity"))


@query("j15_purpose_pairs_per_line", PAIRS + " SELECT CAST(line_id AS BIGINT) AS line_id, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT desc_id) AS BIGINT) AS texts FROM pairs GROUP BY line_id")
def j15(spark, sf):
    per_text = pair_rows(spark, sf).groupBy("line_id", "desc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy(F.col("line_id").cast("bigint").alias("line_id")).agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("texts"))


@query("w06_keys_per_sentence", PAIRS + " SELECT desc_id, CAST(sentence_no AS BIGINT) AS sentence_no, string_agg(unit_key, '|' ORDER BY unit_key) AS keys FROM kk WHERE r2 <= 5 GROUP BY ALL")
def w06(spark, sf):
    names = F.create_map(*[F.lit(x) for p in PURPOSES for x in (p.id, p.key)])
    return pair_rows(spark, sf).groupBy("desc_id", F.col("sentence_no").cast("bigint").alias("sentence_no")).agg(
        F.array_join(F.array_sort(F.collect_set(names[F.col("line_id")])), "|").alias("keys"))


@query("z03_pair_scoring", PAIRS + """ SELECT desc_id, CAST(sentence_no AS BIGINT) AS sentence_no, CAST(line_id AS BIGINT) AS line_id,
    round(1.0 / (1 + abs(length(sentence) - length(purpose))), 6) AS value FROM pairs JOIN sent USING (desc_id, sentence_no) JOIN pl USING (line_id)""")
def z03(spark, sf):
    def load_scorer():
        return lambda sentences, lines: [1.0 / (1 + abs(len(a) - len(b))) for a, b in zip(sentences, lines)]

    return purposes.score_pairs(pair_rows(spark, sf), PURPOSES, load_scorer).select(
        "desc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), F.col("line_id").cast("bigint").alias("line_id"), F.round("value", 6).alias("value"))


@query("a10_best_purpose", DECIDE + " SELECT desc_id, unit_key, rule, round(sim, 4) AS value, sentence FROM bb")
def a10(spark, sf):
    scored = purposes.score_pairs(pair_rows(spark, sf), PURPOSES, None)
    return purposes.best_purposes(scored, PURPOSES, "desc_id").select("desc_id", "unit_key", "rule", F.round("value", 4).alias("value"), "sentence")


@query("z04_purpose_decision", DECIDE + """ SELECT desc_id, unit_key, class, rule, round(sim, 4) AS value, purpose, sentence,
    CASE WHEN round(sim, 4) >= 0.9 THEN 'sicher' WHEN round(sim, 4) >= 0.7 THEN 'wahrscheinlich' ELSE 'zu prüfen' END AS band FROM hit""")
def z04(spark, sf):
    return hits(spark, sf).drop("place")


@query("t04_purpose_top4", DECIDE + " SELECT desc_id, CAST(count(*) AS BIGINT) AS n, string_agg(unit_key, '|' ORDER BY place) AS keys FROM hit GROUP BY desc_id")
def t04(spark, sf):
    return hits(spark, sf).groupBy("desc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "unit_key"))), lambda s: s.unit_key), "|").alias("keys"))


@query("a11_best_hit_per_rule", DECIDE + " SELECT desc_id, rule, arg_min(unit_key, place) AS unit_key, round(max(sim), 4) AS value FROM hit GROUP BY ALL")
def a11(spark, sf):
    per = purposes.per_rule(hits(spark, sf), "desc_id")
    return per.select("desc_id", F.explode("purposes").alias("rule", "h")).select("desc_id", "rule", F.col("h.key").alias("unit_key"), "h.value")


@query("c14_with_purposes")
def c14_purposes(spark, sf):
    """The classifier with the purpose finder as a second trigger of every rule."""
    found = purposes.per_rule(hits(spark, sf), "desc_id")
    return plan.classify(descriptions(spark, sf), BOOK, found).select(
        "desc_id", "heaviest", as_text("classes"), F.array_join(F.transform("hints", lambda h: h["rule"]), "|").alias("rules"),
        F.array_join(F.flatten(F.transform("hints", lambda h: h["basis"])), "|").alias("basis"))
