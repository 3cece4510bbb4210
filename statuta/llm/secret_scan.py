"""Secrets in texts: fixed patterns, and a battery of randomness tests for runs no pattern names.

Everything is a DataFrame expression; no Python runs on the executors. Places of the matches of a pattern
come from the lengths of what lies between them. A run of characters that could be an encoded key, and each
part of it between signs (a key behind the path of a URL or of a file is such a part), gets the smallest
alphabet that holds it and four tests of the hypothesis that its characters are drawn at random from that
alphabet: chi-squared uniformity, runs of character classes, serial correlation, and pairs of letters that are
frequent in written languages. The smallest p-value, times four, is the run's. Within a document the runs are
sifted by the Benjamini-Hochberg rule with weights proportional to length (a long run carries more evidence):
rejected runs are ordinary text, and at most a share of `FALSE_RATE` of those dropped is expected to be
random; the others are reported, without those inside a longer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# the patterns of the base kinds: fixed values
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: a run has one end
HEX = r"[0-9a-f]{24,}"
SECRET_CHARS = 6

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_RATE = 0.001
MASK = "[SECRET]"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
SIGNS = "+/-_"
#: name: (pattern, alphabet), from small to large alphabets; the last one holds every run.
ENCODINGS = {
    "decimal": (r"^[0-9]+=*$", DIGITS),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)=*$", DIGITS + "abcdef"),
    "lower": (r"^[a-z]+=*$", LOWER),
    "upper": (r"^[A-Z]+=*$", UPPER),
    "base32": (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    "base32 lower": (r"^[a-z2-7]+=*$", LOWER + "234567"),
    "base36": (r"^[A-Z0-9]+=*$", UPPER + DIGITS),
    "base36 lower": (r"^[a-z0-9]+=*$", LOWER + DIGITS),
    "letters": (r"^[A-Za-z]+=*$", UPPER + LOWER),
    "base62": (r"^[A-Za-z0-9]+=*$", UPPER + LOWER + DIGITS),
    "base64": (r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": (r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    "any": (r"^[A-Za-z0-9+/_-]+=*$", UPPER + LOWER + DIGITS + SIGNS),
}
#: What a run is parted at: signs outside base 64 with its other signs, or any sign.
PARTED = ("[+/]", "[-_]", "[-+/_]")
LEAST = r"^[A-Za-z0-9+/_-]{20}"
#: A hundred frequent pairs of letters of English, German, French, Spanish and Italian.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ei ie un ge sc ht da ns us ss ue qu la el lo ad do os ta ci di no ni tr pr po mi so su pe ca ac tt em et il ai au ab ag am ap av bi bl bo br cl cr ct"
).split()


def _places(text: Column, pattern: str, found: Column) -> Column:
    """(start, end) of each match, from the lengths of the parts between them; code points."""
    parts = F.split(text, pattern, -1)
    begin = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(so_far: Column, pair: Column) -> Column:
        start = so_far["at"] + F.length(pair["part"])
        end = start + F.length(pair["hit"])
        return F.struct(
            F.concat(so_far["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"), end.alias("at")
        )

    pairs = F.zip_with(
        F.slice(parts, F.lit(1), F.size(found)), found, lambda p, h: F.struct(p.alias("part"), h.alias("hit"))
    )
    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by its logistic approximation."""
    z = F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z * 1.5976 + z * z * z * 0.07056))


def _encoding(run: Column) -> Column:
    name = F.lit(None).cast("string")
    for key, (pattern, _) in reversed(ENCODINGS.items()):
        name = F.when(run.rlike(pattern), F.lit(key)).otherwise(name)
    return name


def _told(name: Column, pick) -> Column:
    value = F.lit(None)
    for key, (_, alphabet) in ENCODINGS.items():
        value = F.when(name == key, F.lit(pick(alphabet))).otherwise(value)
    return value


def _class_moment(power: int):
    classes = (UPPER, LOWER, DIGITS, SIGNS)
    return lambda alphabet: float(sum((sum(c in kind for c in alphabet) / len(alphabet)) ** power for kind in classes))


def _pair_chance(alphabet: str) -> float:
    """The chance that two letters drawn from the alphabet are one of `PAIRS`, in either case."""
    times = {c: alphabet.lower().count(c) for c in LOWER}
    return sum(times[x] * times[y] for x, y in set(PAIRS)) / len(alphabet) ** 2


def _triple_chance(alphabet: str) -> float:
    """The chance that of three letters drawn the first two and the last two are one of `PAIRS`."""
    times = {c: alphabet.lower().count(c) for c in LOWER}
    return sum(times[x] * times[y] * times[z] for x, y in set(PAIRS) for w, z in set(PAIRS) if y == w) / len(alphabet) ** 3


def _candidates(runs: Column) -> Column:
    """The runs and their parts between signs that are long enough: (start, end, run)."""

    def parts(r: Column, sign: str) -> Column:
        begin = F.struct(F.array().cast(RUNS).alias("out"), r["start"].alias("at"))

        def step(s: Column, part: Column) -> Column:
            end = s["at"] + F.length(part)
            found = F.array(F.struct(s["at"].alias("start"), end.alias("end"), part.alias("run")))
            return F.struct(F.when(part.rlike(LEAST), F.concat(s["out"], found)).otherwise(s["out"]).alias("out"), (end + 1).alias("at"))

        return F.aggregate(F.split(r["run"], sign, -1), begin, step, lambda s: s["out"])

    def all_of(r: Column) -> Column:
        whole = F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"), r["run"].alias("run")))
        return F.when(r["run"].rlike(PARTED[-1]), F.array_distinct(F.concat(whole, *[parts(r, sign) for sign in PARTED]))).otherwise(whole)

    return F.flatten(F.transform(runs, all_of))


def _judged(runs: Column) -> Column:
    """Runs with their p-values, in steps so that each figure is computed once: (start, end, n, p)."""

    def read(r: Column) -> Column:
        name = _encoding(r["run"])
        body = F.regexp_replace(r["run"], "=+$", "")
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), name.alias("name"),
            F.when(name == "hex", F.lower(body)).otherwise(body).alias("body"),
        )

    def count(r: Column) -> Column:
        body, alphabet = r["body"], _told(r["name"], lambda a: a)
        same = F.aggregate(
            F.array_distinct(F.split(body, "")),
            F.lit(0.0),
            lambda total, c: total + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)),
        )
        classes = body
        for pattern, sign in (("[A-Z]+", "~"), ("[a-z]+", "."), ("[0-9]+", ","), ("[-+/_]+", ";")):
            classes = F.regexp_replace(classes, pattern, sign)
        places = F.transform(F.split(body, ""), lambda c: F.position(c, alphabet).cast("double"))
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), F.length(body).cast("double").alias("n"),
            _told(r["name"], lambda a: float(len(a))).alias("k"), same.alias("same"),
            F.length(classes).cast("double").alias("runs"), places.alias("places"),
            _told(r["name"], _class_moment(2)).alias("p2"), _told(r["name"], _class_moment(3)).alias("p3"),
            F.regexp_count(F.lower(body), F.lit(f"(?=(?:{'|'.join(sorted(set(PAIRS)))}))")).cast("double").alias("pairs"),
            _told(r["name"], _pair_chance).alias("q2"), _told(r["name"], _triple_chance).alias("q3"),
        )

    def middle(r: Column) -> Column:
        return F.struct(r.alias("r"), (F.aggregate(r["places"], F.lit(0.0), lambda t, x: t + x) / r["n"]).alias("mean"))

    def test(told: Column) -> Column:
        r, mean = told["r"], told["mean"]
        n, k = r["n"], r["k"]
        # chi-squared against equal shares, by the Wilson-Hilferty cube root
        spread = F.lit(2.0) / ((k - 1) * 9)
        chi = (F.cbrt((r["same"] * k / n - n) / (k - 1)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
        # too few runs of one character class; an alphabet of one class has always one
        variance = (n - 1) * (r["p2"] * (F.lit(1.0) - r["p2"]) + (r["p3"] - r["p2"] * r["p2"]) * 2)
        few = F.when(r["p2"] < 1, ((n - 1) * (F.lit(1.0) - r["p2"]) + 1 - r["runs"]) / F.sqrt(variance)).otherwise(F.lit(-20.0))
        # too many frequent pairs of letters; an alphabet without letters has none
        varied = (n - 1) * r["q2"] * (F.lit(1.0) - r["q2"]) + (n - 2) * (r["q3"] - r["q2"] * r["q2"]) * 2
        pairs = F.when(r["q2"] > 0, (r["pairs"] - (n - 1) * r["q2"]) / F.sqrt(varied)).otherwise(F.lit(-20.0))
        # correlation of neighbours' places in the alphabet, either way
        sums = F.aggregate(
            r["places"],
            F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("both"), F.lit(0.0).alias("own")),
            lambda t, x: F.struct(
                (x - mean).alias("before"), (t["both"] + t["before"] * (x - mean)).alias("both"),
                (t["own"] + (x - mean) * (x - mean)).alias("own"),
            ),
        )
        serial = F.when(sums["own"] > 0, F.abs(sums["both"] / sums["own"] + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.lit(20.0))
        least = F.least(_tail(chi), _tail(few), _tail(serial) * 2, _tail(pairs))
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), n.alias("n"), F.least(F.lit(1.0), least * 4).alias("p")
        )

    return F.transform(F.transform(F.transform(F.transform(runs, read), count), middle), test)


def _once(value: Column, use) -> Column:
    """The result of `use`, with the value computed once and not for every element that needs it."""
    return F.transform(F.array(value), use)[0]


def _sifted(judged: Column, rate: float) -> Column:
    """The runs that the weighted Benjamini-Hochberg rule does not reject as random, without those inside
    another one: (start, end)."""
    m = F.size(judged)
    scaled = _once(
        F.aggregate(judged, F.lit(0.0), lambda t, r: t + r["n"]),
        lambda total: F.transform(judged, lambda r: F.struct(
            r["start"].alias("start"), r["end"].alias("end"), (r["p"] * total / (r["n"] * m)).alias("q"))),
    )

    def kept(rows: Column) -> Column:
        passed = F.transform(
            F.array_sort(F.transform(rows, lambda r: r["q"])), lambda q, i: F.when(q <= (i + 1) * F.lit(rate) / m, q)
        )
        return _once(F.coalesce(F.array_max(passed), F.lit(-1.0)), lambda limit: F.filter(rows, lambda r: r["q"] > limit))

    outer = F.array_sort(
        F.transform(_once(scaled, kept), lambda r: F.struct(r["start"].alias("start"), (-r["end"]).alias("back")))
    )
    begin = F.struct(F.array().cast(NONE).alias("out"), F.lit(-1).alias("at"))

    def step(s: Column, x: Column) -> Column:
        span = F.array(F.struct(x["start"].alias("start"), (-x["back"]).alias("end")))
        return F.struct(F.when(-x["back"] > s["at"], F.concat(s["out"], span)).otherwise(s["out"]).alias("out"), F.greatest(s["at"], -x["back"]).alias("at"))

    return F.aggregate(outer, begin, step, lambda s: s["out"])


NONE = "array<struct<start:int,end:int>>"
RUNS = "array<struct<start:int,end:int,run:string>>"
SPAN = "array<struct<start:int,no:int,kind:string,end:int>>"


def spans(docs: DataFrame, text_col: str = "text", rate: float = FALSE_RATE) -> DataFrame:
    """(_row, _base, _all): the row as a struct, so that no name of its columns meets one of these, and its
    spans (start, no, kind, end) by start and then kind, in code points."""
    text = F.col("_text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(row.alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    patterns = {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_run": RUN}
    df = df.withColumns({k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    df = df.withColumn(
        "_values", F.when(F.size("_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    )
    df = df.withColumns(
        {
            f"{k}_at": F.when(F.size(k) > 0, _places(text, p, F.col(k))).otherwise(F.array().cast(NONE))
            for k, p in patterns.items()
        }
    )
    long = F.filter(
        F.arrays_zip(F.col("_assign_at").alias("at"), F.col("_values").alias("value")),
        lambda x: F.length(x["value"]) >= SECRET_CHARS,
    )
    df = df.withColumn(
        "_assign_at",
        F.when(F.size("_assign") > 0, F.transform(long, lambda x: x["at"])).otherwise(F.array().cast(NONE)),
    )

    def spelled(at: Column, no: int) -> Column:
        return F.transform(
            at,
            lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), F.lit(KINDS[no]).alias("kind"), x["end"].alias("end")),
        )

    base = F.concat(*[spelled(F.col(f"_{k}_at"), i) for i, k in enumerate(KINDS[:3])])
    df = df.withColumn("_base", F.array_sort(base))
    runs = F.zip_with(
        F.col("_run_at"), F.col("_run"), lambda at, run: F.struct(at["start"].alias("start"), at["end"].alias("end"), run.alias("run"))
    )
    apart = lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    df = df.withColumn("_judged", F.when(F.size("_run") > 0, _judged(F.filter(_candidates(runs), apart))))
    found = F.when(F.size("_judged") > 0, _sifted(F.col("_judged"), rate)).otherwise(F.array().cast(NONE))
    df = df.withColumn("_all", F.array_sort(F.concat(F.col("_base"), spelled(found, 3))))
    return df.select("_row", "_base", "_all")


def _spelled(at: Column) -> Column:
    return F.array_join(
        F.transform(at, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_RATE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    A null text counts as empty: no spans, the hash of the empty string. Spans that start together come in
    the order of `KINDS`; runs and parts that overlap a span of a fixed pattern are not tested again. Repeated rows and
    null ids are kept; an empty table gives an empty result; columns other than the two named ones are not
    read. Texts of any length are scanned whole.
    """
    rows = spans(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), "text", rate)
    of = lambda i: F.size(F.filter("_base", lambda x: x["no"] == i)).cast("long")
    return rows.select(
        F.col("_row").getField(id_col).alias(id_col),
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_spelled(F.col("_base")), 256).alias("base_sha256"),
        _spelled(F.col("_all")).alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows with every span of `text` replaced by the mask, and n_chars counted anew where it is one.

    Overlapping spans are replaced together. Rows without spans, and null texts, stay as they are, as do all
    other columns, whatever their names.
    """
    rows = spans(docs)
    whole = F.col("_row").getField("text")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        between = F.substring(whole, s["at"] + 1, x["start"] - s["at"])
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], between, F.lit(mask))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    clean = F.aggregate(
        "_all", begin, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole)))
    )
    found = F.size("_all") > 0
    rows = rows.select("_row", found.alias("_found"), F.when(found, clean).otherwise(whole).alias("_clean"))
    columns = {c: F.col("_row").getField(c) for c in docs.columns}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("_found"), F.length("_clean").cast(kind)).otherwise(columns["n_chars"])
    columns["text"] = F.col("_clean")
    return rows.select(*[value.alias(c) for c, value in columns.items()])
