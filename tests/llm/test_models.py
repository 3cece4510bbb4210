"""Language identification, mixing and page extraction: held-out accuracy, exact targets, brute force."""

import html
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statuta.llm import features
from statuta.llm import html_extract as H
from statuta.llm import language_id as L
from statuta.llm import mixing as M

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_held_out_languages(documents):
    found = L.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, low, high = found.agg(
        F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang"), F.min("score"), F.max("score")
    ).first()
    assert n > 100 and right / n > 0.99 and 0 <= low <= high <= 1
    assert found.where("rejected").count() <= n / 100


def test_languages_of_odd_rows(odd, empty, documents):
    model = L.train(documents.limit(200))
    rows = L.predict(odd, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 8 and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (2, 3, 4))
    assert by[1]["lang_pred"] in model.languages
    assert L.predict(empty, model).collect() == []
    assert {r["lang_pred"] for r in L.predict(odd, None).collect()} == {"und"}
    kept = L.keep(odd, model).collect()
    assert {r["doc_id"] for r in kept}.isdisjoint({2, 3, 4}) and kept[0].asDict().keys() == set(odd.columns)
    assert L.train(empty.withColumn("lang", F.lit("x"))) is None


def test_text_without_known_subwords_is_less_certain(documents):
    model = L.train(documents.limit(300))
    scorer = L.Scorer(model)
    junk = "".join(random.Random(1).choice("QXZJKVW#%&") for _ in range(400))
    text = documents.where("lang = 'en'").first()["text"]
    assert scorer.probabilities(junk).max() < scorer.probabilities(text).max()


def test_the_store_of_words_starts_anew(documents):
    model = L.train(documents.limit(100))
    scorer, small = L.Scorer(model), L.Scorer(model)
    small.KEEP = 2
    for r in documents.limit(20).collect():
        assert np.allclose(scorer.probabilities(r["text"]), small.probabilities(r["text"]))


def test_domains_and_targets(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    targets = {"high": 0.9, "low": 0.1, "toxic": 0.0}
    rows = M.mixed(documents, labels, M.quality_domain(), targets, sample=200).collect()
    assert len(rows) == documents.count()
    p, t, r = np.array([x["posterior"] for x in rows]), np.array([x["n_tokens"] for x in rows]), np.array([x["rate"] for x in rows])
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.abs((r * t) @ p / t.sum() - [0.9, 0.1, 0.0]).max() < 0.01
    told = {x["doc_id"]: x["domain"] for x in labels.select("doc_id", M.quality_domain().alias("domain")).collect()}
    seen = [(told[x["doc_id"]], x["domain"]) for x in rows if told.get(x["doc_id"])]
    assert np.mean([a == b for a, b in seen]) > 0.85


def test_rates_are_the_least_squares_solution():
    """The rounds against a long, plain projected gradient on the same problem."""
    r = np.random.default_rng(0)
    p = r.dirichlet([0.3, 0.3, 0.3], 300)
    t = r.integers(1, 500, 300).astype(float)
    w, total = np.array([0.6, 0.4, 0.0]), t.sum()
    a = p * t[:, None] / total
    residuals = []
    for _ in range(400):
        ahead = M.rates_of(p, residuals, M.RIDGE)[1]
        residuals.append(ahead @ a - w)
    fast = M.rates_of(p, residuals, M.RIDGE)[0]
    slow = np.ones(300)
    for _ in range(60_000):
        slow = np.maximum(0, slow - 0.9 * (p @ (slow @ a - w) + M.RIDGE * (slow - 1)))
    cost = lambda x: 0.5 * ((x @ a - w) ** 2).sum() + M.RIDGE / 2 * (t / total * (x - 1) ** 2).sum()
    assert cost(fast) <= cost(slow) + 1e-7 and np.abs(fast @ a - slow @ a).max() < 1e-3


def test_fit_solves_its_weighted_problem(spark):
    """`fit` itself, over a table, against a long plain projected gradient on the weighted squares."""
    r = np.random.default_rng(1)
    p, t = r.dirichlet([0.2, 0.3, 0.1], 400), r.integers(1, 300, 400).astype(float)
    total, w = t.sum(), np.array([0.7, 0.3, 0.0])
    a = p * t[:, None] / total
    s = a.sum(axis=0)
    table = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens long, posterior array<double>")
    fast = M.rates_of(p, M.fit(table, w, s, total), M.RIDGE)[0]
    slow = np.ones(400)
    for _ in range(100_000):
        slow = np.maximum(0, slow - 0.9 * (p @ ((slow @ a - w) / s) + M.RIDGE * (slow - 1)))
    cost = lambda x: 0.5 * ((x @ a - w) ** 2 / s).sum() + M.RIDGE / 2 * (t / total * (x - 1) ** 2).sum()
    assert cost(fast) <= cost(slow) * 1.01 + 1e-7 and np.abs(fast @ a - slow @ a).max() < 3e-3


def test_a_batch_is_judged_as_its_texts_one_by_one(spark):
    r = random.Random(6)
    some = "calm Garden window idiot 2024 re-do l'eau 蠢货 ÄÖ x  \t\n .. ŁÓDŹ".split(" ")
    texts = [" ".join(r.choices(some, k=r.randrange(0, 60))) for _ in range(600)] + ["", "  ", "a a a"]
    model = M.train(spark.createDataFrame([(x, "toxic" if "idiot" in x else "high") for x in texts], "text string, domain string"))
    n, p = model.judge(pa.array(["z", *texts]).slice(1), model.finder())
    assert n.tolist() == [len(x.split()) for x in texts]
    assert np.allclose(p, model.posteriors([model.row(*M.text_features(x, M.Memo(M.word_features))) for x in texts]), atol=1e-12)


def test_features_of_many_words_are_those_of_each(monkeypatch):
    r = random.Random(8)
    signs = "aaabbcdeEFÄßéİıŁžſ0129²½_-.'/!~µªḂΣ蠢ไ\U0001d400\x7f"
    words = ["".join(r.choices(signs, k=r.choice([0, 1, 3, 4, 5, 8, 30]))) for _ in range(3000)]
    words += ["a" * 5000 + "b", "ab" * 3000, "-" * 40, "z" * 7]
    all_features = sorted({f for w in words for f in M.word_features(w)})
    names = {f: i for i, f in enumerate(r.sample(all_features, 2 * len(all_features) // 3))}
    monkeypatch.setattr(features, "TOGETHER", 1000)
    for chosen in (names, {"w b": 0, "=": 1}, {}):
        size, flat = features.Finder(chosen)(words)
        found = np.split(flat, np.cumsum(size)[:-1])
        for w, numbers in zip(words, found):
            assert sorted(numbers.tolist()) == sorted(chosen[f] for f in M.word_features(w) if f in chosen), w
    assert [len(x) for x in features.Finder(names)([])] == [0, 0]


def test_a_document_of_two_labels_is_learnt_as_both(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    found = sorted((r["text"], r["domain"]) for r in M.labelled_sample(docs, labels, M.quality_domain()).collect())
    assert found == [("a b", "high"), ("a b", "low"), ("c d", "toxic")]


def test_mixing_of_odd_rows(spark, odd, empty, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    none = M.mixed(odd, labels.limit(0), M.quality_domain(), None).collect()
    assert len(none) == 8 and {x["rate"] for x in none} == {1.0} and {x["domain"] for x in none} == {None}
    both = documents.select("doc_id", "text").limit(150).unionByName(odd.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    rows = M.mixed(both, labels, M.quality_domain(), {"toxic": 0.0}).collect()
    assert len(rows) == 158 and all(x["n_tokens"] == 0 or x["rate"] >= 0 for x in rows)
    assert M.mixed(empty, labels, M.quality_domain(), None).collect() == []
    out = M.resampled(odd.withColumn("rate", F.lit("mine")), labels.limit(0), {"toxic": 0.0})
    assert out.columns == [*odd.columns, "rate"] and out.count() == 8


def test_a_word_is_seen_wherever_it_stands(spark):
    r = random.Random(4)
    calm = "garden window morning letter river bridge music paper".split()
    rows = [(" ".join(r.choices(calm, k=12) + ["idiot", "蠢货"] * (i % 2)), "toxic" if i % 2 else "high") for i in range(200)]
    model = M.train(spark.createDataFrame(rows, "text string, domain string"))
    at = model.domains.index("toxic")

    def toxic(text):
        return model.posteriors([model.row(*M.text_features(text, M.Memo(M.word_features)))])[0][at]

    for place in ("l'{}", "d’{}", "you-{}", "he/{}", "end.{}", "word—{}", "garden{}window", "x" * 70 + "-{}"):
        assert toxic("music paper " + place.format("idiot")) > 0.5 > toxic("music paper " + place.format("river")), place
    assert toxic("今天天气很好你这个蠢货走开") > 0.5 > toxic("music paper 今天天气很好你这个朋友走开")


def test_the_shape_is_that_of_the_whole_word():
    a, b = (M.word_features("1a2b-" * 20 + end) for end in ("!", "?"))
    assert set(a) != set(b)


def test_a_task_rates_its_rows_with_one_python_worker(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = M.resampled(documents, labels, {"toxic": 0.0})
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_copies_have_the_rate_as_mean(spark):
    rows = spark.range(4000).select(M.copies(F.lit(1.5), F.col("id").cast("string")).alias("c"), M.copies(F.lit(0.97), F.col("id").cast("string")).alias("d"))
    mean, least, most = rows.agg(F.avg("c"), F.min("d"), F.max("d")).first()
    assert abs(mean - 1.5) < 0.05 and (least, most) == (0, 1)
    assert abs(rows.agg(F.avg("d")).first()[0] - 0.97) < 0.01


PAGES = {
    "<p>a &amp; b<p>c": "a & b\nc",
    "": "",
    "<article><h1>T</h1><p>x  y\n z</p><div class='comments'><p>c</p></div><p>w<b>o</b>rd<br>n</p></article>": "T\nx y z\nword n",
    "<nav><a href=x>m</a></nav><main><p>Real &lt;text&gt;, and more of it.</p></main><footer>f</footer>": "Real <text>, and more of it.",
    "<main><p>kept</p><script>if (a<b) { '</p>' }</script><style>p{}</style><form><p>no</p></form></main>": "kept",
    "<main><p>cut": "cut",
    "<main><p>one</p><!-- <p>no</p> --><p>two</p><div class=": "one\ntwo",
    "<main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>": "a\nb\nc\nd",
}


@pytest.fixture(scope="module")
def trees(spark):
    return H.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_small_pages(trees):
    assert dict(zip(PAGES, H.extract(list(PAGES), trees))) == PAGES


def test_whole_table_equals_its_articles(spark, trees):
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = {r["page_id"]: r for r in H.main_text(pages, trees=trees).collect()}
    for page in pages.collect():
        inside = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page["html"])[1]
        parts = [re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", x) for x in re.split(r"</?(?:p|h1|div)[^>]*>", inside)]
        want = "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in parts) if x)
        got = rows[page["page_id"]]
        assert (got["text"], got["n_chars"], got["url"]) == (want, len(want), page["url"])


def test_odd_pages(spark, trees):
    rows = spark.createDataFrame(
        [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<main>t", "x"), (3, "u", "<p>" + "long words " * 40000, "x"), (3, "u", "<p>s", "x")],
        "page_id long, url string, html string, text string",
    )
    found = H.main_text(rows, trees=trees).collect()
    assert [r["n_chars"] for r in found][:3] == [0, 0, 1] and found[3]["n_chars"] == 40000 * 11 - 1 and len(found) == 5
    assert H.main_text(rows.limit(0)).collect() == []
    assert [r["text"] for r in H.main_text(rows.limit(3), learn=False).collect()] == ["", "", "t"]


def test_nothing_is_kept_below_a_dropped_element():
    r = np.random.default_rng(3)
    for _ in range(40):
        n = 9
        parent = [-1, *(int(r.integers(0, i)) for i in range(1, n))]
        odds = r.normal(0, 2, n)
        best, kept = -np.inf, None
        for bits in range(1 << (n - 1)):
            choice = [True, *(bool(bits >> i & 1) for i in range(n - 1))]
            if all(choice[parent[i]] or not choice[i] for i in range(1, n)):
                value = sum(-np.logaddexp(0, -odds[i] if choice[i] else odds[i]) for i in range(1, n))
                if value > best:
                    best, kept = value, choice
        assert H.decode(parent, odds).tolist() == kept


def read_text(source):
    return [text for _, text, _ in H.Page(source).text]


@pytest.mark.parametrize(
    "source, texts",
    [
        ("<script src=/a.js/>var x=1;</script><p>ok", ["ok"]),
        ("<title/>t</title><p>ok", ["ok"]),
        ("<p>a</p><button>b<p>c</p>", ["a", "c"]),
        ("<nav><button>m</nav><p>c</p><button>n</button>", ["c"]),
        ("<button>a<div>b</div></button>c", ["c"]),
        ("<p>1<button>2<button>3</button>4", ["14"]),
        ("<select><option>a<option>b</select>c", ["c"]),
        ("<p>a<svg/>b<video><p>no</p></video>", ["ab"]),
        ('<a href="x"" class=y>link</a> t', ["link t"]),
        ("<p title='>t</p><p>u", ["t", "u"]),
        ('<p title="a>b">t', ["t"]),
        ('<p>x < y <3 "q" <!--> z', ['x < y <3 "q" z']),
        ("<p>a<script>b", ["a"]),
        ("<p>a<b c", ["a"]),
    ],
)
def test_broken_markup_is_read_as_far_as_it_goes(source, texts):
    assert read_text(source) == texts


@pytest.mark.parametrize(
    "source",
    [
        lambda n: "<a " * n + '"',
        lambda n: '<a x="' * n,
        lambda n: "<div>" * n + "<p>x" * n,
        lambda n: "<p><table>" + "<div>" * n + "<p>x" * n,
        lambda n: "<button>" * n + "<script>" * n + "<!-- " * n,
        lambda n: "<video>x" * n + "</video>" * n,
        lambda n: "<ul>" * n + "<li>a" * n,
    ],
)
def test_time_to_read_grows_with_the_page_only(source):
    page = source(40_000)
    start = time.process_time()
    H.Page(page)
    assert time.process_time() - start < 30  # a square would take hours


def test_sample_does_not_hang_on_ids(spark):
    """Rows without an id, and rows alike, neither fill the sample nor stay out of it as one."""
    table = spark.read.parquet(f"{FOLDER}/pages.parquet").select(F.lit(None).cast("long").alias("page_id"), "url", "html")
    assert H.train(table.unionByName(table).unionByName(table), sample=200) is not None
