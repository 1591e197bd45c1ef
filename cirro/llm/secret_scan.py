"""Secrets in texts: three fixed patterns and a battery of randomness tests.

DataFrame functions only.  The patterns give the base spans.  Every other
run of 20 or more characters that an encoding can be inferred for (hex,
base32, upper alphanumeric, alphanumeric, base64, URL base64; at least one
digit) is tested against "independent uniform characters of that alphabet"
by three tests.  A run ends at '=', so a value is tested without the name
before it; '=' that pad its end belong to the span, not to what is tested.
The tests:

* chi-squared of the character counts (Wilson-Hilferty),
* runs above and below the alphabet's middle (Wald-Wolfowitz),
* serial correlation of neighbouring characters.

Their p-values are combined by Fisher's method.  Ordinary identifiers and
words fail the tests; a Benjamini-Hochberg step within each length class
(short strings have little power, so they are not judged by the long
ones' threshold) bounds the share of truly random strings among those
put aside.  What is left is reported as kind ``random``, unless it overlaps
a base span.

The text is scanned once.  The spans and p-values found are staged, the
thresholds come from a histogram of them, and the last step reads only the
staged rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import stage

# The patterns of the base kinds (Java syntax) and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ["assign", "access", "hex", "random"]

# A run and the '=' that pad it (base64: up to 2, base32: up to 6) where no further run is glued to them.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
HAS_CANDIDATE = r"(?=[A-Za-z+/_-]{0,40}[0-9])[A-Za-z0-9+/_-]{20}"
# (encoding, pattern, alphabet): the first pattern that holds is the encoding inferred.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("upper hex", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("upper", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("lower", "^[a-z0-9]+$", DIGITS + LOWER),
    ("alnum", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", DIGITS + UPPER + LOWER + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", DIGITS + UPPER + LOWER + "_-"),
]
LENGTH_CLASSES = [20, 32, 48, 64]
BIN = 50                                                    # histogram bins per unit of -ln p
MOST = 700                                                  # largest -ln p


GROUP = 128
PART = 4096                                                 # code points of a text that are put together at once


def grouped(rows, total, add, start, body):
    """flatten of ``body(group, state before it)`` over groups of ``GROUP`` rows; the state after a group is
    ``add(state, total(group))``.  So running quantities of n rows cost n x GROUP steps, not n x n."""
    def inside(groups):
        def states(totals):
            first = F.struct(start.alias("now"), F.array(start).alias("all"))
            return F.aggregate(totals, first, lambda acc, t: _let(add(acc["now"], t), lambda now: F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))))["all"]
        return F.flatten(_let(states(F.transform(groups, total)), lambda all_: F.transform(groups, lambda g, i: body(g, F.get(all_, i)))))

    def cut(rows):
        last = F.floor((F.size(rows) - 1) / GROUP).cast("int")
        return F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * GROUP + 1, GROUP))).otherwise(F.array(rows))
    return _let(rows, lambda r: _let(cut(r), inside))


def _let(value, body):
    """``body`` of a value that is worked out once (a lambda's variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text, pattern: str, least_group: int | None = None):
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches alternate, so running
    lengths give the positions.  ``least_group``: least length of group 2.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least_group else hits
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    rows = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), value.alias("value"))
    length = lambda group: F.aggregate(group, F.lit(0), lambda a, x: a + F.length(x["gap"]) + F.length(x["hit"]))
    spans = grouped(rows, length, lambda at, n: at + n, F.lit(0),
                    lambda group, at: F.aggregate(group, F.struct(at.alias("at"), none.alias("spans")), step)["spans"])
    if least_group:
        spans = F.filter(spans, lambda x: F.length(x["value"]) >= least_group)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _two_sided(z):
    """2 * (1 - Phi(|z|)); rational approximation of erfc, absolute error under 2e-7."""
    def tail(v):
        poly = F.lit(1.061405429)
        for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
            poly = v["t"] * poly + c
        return F.least(F.lit(1.0), v["t"] * poly * F.exp(-v["x"] * v["x"]))
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    return _let(F.struct(x.alias("x"), (1 / (1 + 0.3275911 * x)).alias("t")), tail)


def _upper(z):
    return _let(F.struct(z.alias("z"), (_two_sided(z) / 2).alias("h")), lambda v: F.when(v["z"] >= 0, v["h"]).otherwise(1 - v["h"]))


def minus_log_p(token, alphabet):
    """-ln of the combined p-value of ``token`` under uniform random characters of ``alphabet``."""
    k = F.length(alphabet).cast("double")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double") - 1)
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, c: a + F.pow(
        F.length(token) - F.length(F.replace(token, c, F.lit(""))), 2))

    def add(acc, x):
        high = (x >= k / 2).cast("double")
        first = acc["n"] == 0
        return F.struct((acc["n"] + 1).alias("n"), (acc["s"] + x).alias("s"), (acc["ss"] + x * x).alias("ss"),
                        F.when(first, F.lit(0.0)).otherwise(acc["lag"] + acc["last"] * x).alias("lag"),
                        F.when(first, x).otherwise(acc["first"]).alias("first"), x.alias("last"),
                        (acc["high"] + high).alias("high"),
                        F.when(first | (high != acc["side"]), acc["runs"] + 1).otherwise(acc["runs"]).alias("runs"),
                        high.alias("side"))

    names = ["n", "s", "ss", "lag", "first", "last", "high", "runs", "side"]
    sums = F.aggregate(codes, F.struct(*[F.lit(0.0).alias(c) for c in names]), add)

    def centred(v):
        s, n = v["s"], v["s"]["n"]
        mean = s["s"] / n
        return F.struct(
            n.alias("n"), v["k"].alias("k"), (v["k"] / n * v["squares"] - n).alias("chi"), s["runs"].alias("runs"),
            (s["lag"] - mean * (2 * s["s"] - s["first"] - s["last"]) + (n - 1) * mean * mean).alias("cross"),
            (s["ss"] - n * mean * mean).alias("spread"), (2 * s["high"] * (n - s["high"]) / n + 1).alias("expected"))

    def scores(v):
        n, df = v["n"], v["k"] - 1
        z_chi = (F.pow(F.greatest(v["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z_serial = F.when(v["spread"] > 1e-9, (v["cross"] / v["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
        variance = (v["expected"] - 1) * (v["expected"] - 2) / (n - 1)
        z_runs = F.when(variance > 1e-9, (v["runs"] - v["expected"]) / F.sqrt(variance)).otherwise(F.lit(40.0))
        return F.array(_upper(z_chi), _two_sided(z_serial), _two_sided(z_runs))

    def fisher(p):
        half = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.log(F.greatest(x, F.lit(1e-100))))
        return _let(half, lambda h: F.least(F.lit(float(MOST)), h - F.log(1 + h + h * h / 2)))

    start = F.struct(sums.alias("s"), k.alias("k"), squares.alias("squares"))
    return _let(_let(_let(start, centred), scores), fisher)


def _alphabet(token):
    out = F.lit(None).cast("string")
    for _, pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(out)
    return out


def _length_class(n):
    out = F.lit(0)
    for i, least in enumerate(LENGTH_CLASSES):
        out = F.when(n >= least, i).otherwise(out)
    return out


def thresholds(scanned: DataFrame, fdr: float) -> dict[int, float]:
    """Per length class the least -ln p that the step-up rule puts aside (infinite: none)."""
    cand = scanned.select(F.explode("candidates").alias("c")).select(
        _length_class(F.col("c.n")).alias("length_class"), F.floor(F.col("c.mlp") * BIN).alias("bin"))
    bins = cand.groupBy("length_class", "bin").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy("length_class")
    # A bin's largest p is exp(-bin / BIN); rank = strings with a p as small.
    ranks = bins.select("length_class", "bin", F.sum("n").over(w.orderBy(F.desc("bin"))).alias("rank"), F.sum("n").over(w).alias("m"))
    cut = ranks.where(F.exp(-F.col("bin") / BIN) <= fdr * F.col("rank") / F.col("m")).groupBy("length_class").agg(F.min("bin").alias("bin"))
    found_rows = {r["length_class"]: r["bin"] / BIN for r in cut.collect()}           # one row per length class
    return {i: found_rows.get(i, float("inf")) for i in range(len(LENGTH_CLASSES))}


def scan(docs: DataFrame, fdr: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the columns ``keep``, by default doc_id) and the spans found, one row per document.

    ``assign``, ``access``, ``hex``, ``random``: arrays of (start, kind, end)
    by kind; ``base`` the first three and ``found`` all, sorted by start and
    kind.  ``kind`` counts in KINDS, positions are code points, ends
    exclusive.  ``docs`` needs doc_id and text.  Null and empty texts have
    no spans; null doc_ids stay null; rows that repeat a doc_id are scanned
    one by one; very long texts are scanned whole; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cand = F.transform(F.filter(found(text, CANDIDATE), lambda x: x["value"].rlike("[0-9]")), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.rtrim(x["value"], F.lit("=")).alias("value")))
    cand = F.transform(cand, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _alphabet(x["value"]).alias("alphabet")))
    cand = F.transform(F.filter(cand, lambda x: x["alphabet"].isNotNull()), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.length(x["value"]).alias("n"), minus_log_p(x["value"], x["alphabet"]).alias("mlp")))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,n:int,mlp:double>>)")

    def bare(spans, kind):
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    scanned = stage(docs.select(
        F.struct(*(keep or ["doc_id"])).alias("row"),
        bare(found(text, ASSIGN, ASSIGN_LEAST), 0).alias("assign"),
        bare(found(text, ACCESS), 1).alias("access"),
        bare(found(text, HEX), 2).alias("hex"),
        F.when(text.rlike(HAS_CANDIDATE), cand).otherwise(empty).alias("candidates"),
    ), "secrets")
    cut = thresholds(scanned, fdr)
    base = F.sort_array(F.concat("assign", "access", "hex"))

    def kept(x):
        limit = F.lit(float("inf"))
        for i, least in enumerate(LENGTH_CLASSES):
            limit = F.when(x["n"] >= least, F.lit(cut[i])).otherwise(limit)
        clear = ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return (x["mlp"] < limit) & clear

    out = scanned.withColumn("base", base).withColumn("random", bare(F.filter("candidates", kept), 3))
    return out.select("row", "assign", "access", "hex", "random", "base", F.sort_array(F.concat("base", "random")).alias("found"))


def redact(docs: DataFrame, fdr: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span found replaced by ``mark`` (spans that overlap: by one); all columns stay.

    ``n_chars``, if there, becomes the new length of the changed texts.
    """
    out = scan(docs, fdr, docs.columns)
    text = F.col("row.text")
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,fresh:boolean>>)")

    # What each span covers that none before it does; spans that overlap the one before have no mark of their own.
    def rest(acc, x):
        span = F.struct(F.greatest(x["start"], acc["at"]).alias("start"), x["end"].alias("end"), (x["start"] >= acc["at"]).alias("fresh"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["end"] > acc["at"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    furthest = lambda group: F.aggregate(group, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
    gone = grouped(F.col("found"), furthest, lambda at, end: F.greatest(at, end), F.lit(0),
                   lambda group, at: F.aggregate(group, F.struct(at.alias("at"), none.alias("spans")), rest)["spans"])

    def part(chunk, number, spans):
        """One part of the text without what the spans cover; a mark stands where its span begins."""
        low = number * PART
        own = F.filter(spans, lambda g: (g["start"] < low + PART) & (g["end"] > low))

        def cut(acc, g):
            head = F.substr(chunk, acc["at"] - low + 1, F.greatest(g["start"] - acc["at"], F.lit(0)))
            return F.struct(F.least(g["end"], low + PART).alias("at"), F.concat(acc["text"], head, F.when(g["fresh"] & (g["start"] >= low), F.lit(mark)).otherwise("")).alias("text"))

        return F.aggregate(own, F.struct(low.alias("at"), F.lit("").alias("text")), cut, lambda acc: F.concat(acc["text"], F.substr(chunk, acc["at"] - low + 1)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    merged = _let(gone, lambda spans: F.array_join(F.transform(chunks, lambda chunk, i: part(chunk, i, spans)), ""))
    new = F.when(F.size("found") > 0, merged).otherwise(text)
    length = F.when(F.size("found") > 0, F.length(merged)).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None
    kinds = dict(docs.dtypes)
    fields = [new.alias(c) if c == "text" else length.cast(kinds[c]).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c)
              for c in docs.columns]
    return out.select(F.struct(*fields).alias("row")).select("row.*")                # a struct, as names may clash


def span_text(spans):
    """'kind:start:end' of each span, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    return scanned.select(F.col("row.doc_id").cast("long").alias("doc_id"), *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")],
                          F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                          span_text(F.col("found")).alias("spans"), F.size("random").cast("long").alias("n_random"))
