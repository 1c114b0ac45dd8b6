"""Secret scans: known patterns, and a battery of randomness tests for long tokens. DataFrame functions only.

Known patterns give the base spans. Beside them, every run of 20 or more letters, digits and ``+/_-`` is
measured. Its encoding is inferred (hex, base 32, base 36 of either case, that with signs, base 64); against that
encoding's alphabet a chi-squared test of uniformity, a runs test about the middle of the alphabet and a test of
serial correlation give three tail probabilities, joined by Fisher's method into the token's misfit (minus its
logarithm): small for random strings, and growing with the length of words. Tokens of letters alone are no
encoding: over the whole corpus they show the mean and the spread of the misfit by the letter, and so how
improbable a token's small misfit is for ordinary text of its length; ``ORDINARY`` tokens of a fixed prior are
counted with them, so that a corpus with few is judged too. Over these probabilities the Benjamini-Hochberg rule
at ``rate`` picks the tokens that count as secrets; it reads a table of bins of set size, however large the corpus.

Work is linear in a text's length, but for places, which take the power 1.5 of the number of matches in a text.

Defined results: null and empty texts have no spans; a corpus without ordinary tokens is judged by the prior;
places are code points, ends exclusive; spans that overlap are all reported, and redacted as one; rows that share
a doc_id are scanned one by one; an empty table gives none. The input's own columns stay under any names; in
scan() only, its columns spans and base give way to the new ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

#: Fixed patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of 24 characters or more is matched whole, a shorter one nowhere
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

RATE = 0.05
BINS, BINS_EACH = 400, 4
#: Least length of a token, and ordinary tokens that the prior counts for.
LEAST, ORDINARY = 20, 10
#: Of those: letters of each, mean and spread of the misfit by the letter (as of 24 long words and paths in four languages).
PRIOR = (24, 0.56, 1.7)
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Pattern, alphabet and whether it may be a secret, first match first.
ENCODINGS = (
    ("[0-9]+", "0123456789", None),
    ("[0-9a-f]+", "0123456789abcdef", True),
    ("[0-9A-F]+", "0123456789ABCDEF", True),
    ("[A-Za-z+/]+", _BASE64, False),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", True),
    ("[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz", True),
    ("[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", True),
    ("[0-9a-z+/]+", "0123456789abcdefghijklmnopqrstuvwxyz+/", True),
    ("[0-9A-Z+/]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/", True),
    ("[0-9A-Za-z+/]+", _BASE64, True),
)


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.transform(F.array(value), of)[0]


def _sums_before(values: Column) -> Column:
    """The sum of the values before each, for a short array."""
    none = F.expr("cast(array() as array<int>)")
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _places(values: Column) -> Column:
    """The sum of the values before each, in blocks of the root of their number."""

    def blocked(side: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / side).cast("int")), lambda b: F.slice(values, b * side + 1, side))
        totals = lambda blocks: F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
        return _let(cut, lambda blocks: F.flatten(F.zip_with(blocks, _sums_before(totals(blocks)), lambda x, base: F.transform(_sums_before(x), lambda v: v + base))))

    return _let(F.ceil(F.sqrt(F.size(values))).cast("int"), blocked)


def located(text: Column, pattern: str) -> Column:
    """Start, end and string of each match: what the pattern splits apart tells the places of what it finds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
        ends = F.zip_with(_places(steps), steps, lambda before, own: before + own)
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))

    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), _let(matches, placed)).otherwise(none)


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))


def base_spans(text: Column) -> Column:
    """The spans of the known patterns, by start, then kind."""
    assigned = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    access = F.filter(located(text, ACCESS), lambda x: x["e"] - x["s"] >= 20)
    return F.array_sort(F.concat(_spans(assigned, 0), _spans(access, 1), _spans(located(text, HEX), 2)))


def _upper_tail(z: Column) -> Column:
    """About 1 - Phi(z), and never zero."""
    return F.greatest(1 / (1 + F.exp(F.least(0.07056 * z * z * z + 1.5976 * z, F.lit(200.0)))), F.lit(1e-80))


def _half_sum(uniform: Column, runs: Column, serial: Column) -> Column:
    """Fisher's statistic for three tests, halved."""
    return -(F.log(uniform) + F.log(F.least(2 * runs, F.lit(1.0))) + F.log(F.least(2 * serial, F.lit(1.0))))


def misfit(places: Column, size: Column) -> Column:
    """Minus the logarithm of the joint tail probability of the three tests, for letters' places in an alphabet of that size."""
    n = F.size(places).cast("double")
    squares = F.aggregate(F.array_distinct(places), F.lit(0.0), lambda a, v: a + F.pow(n - F.size(F.array_remove(places, v)), 2))
    df = size - 1
    spread = 2 / (9 * df)
    uniform = _let((F.pow(F.greatest(size / n * squares - n, F.lit(0.0)) / df, 1 / 3) - (1 - spread)) / F.sqrt(spread), _upper_tail)
    steps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def by_runs(x: Column) -> Column:
        """Of n, the letters in the upper half, and the runs of halves."""
        expected = 2 * x["high"] * (x["n"] - x["high"]) / x["n"] + 1
        return _let(F.struct(x["runs"].alias("runs"), expected.alias("mean"), ((expected - 1) * (expected - 2) / (x["n"] - 1)).alias("variance")), lambda m: _let(F.when(m["variance"] > 0, F.abs(m["runs"] - m["mean"]) / F.sqrt(m["variance"])).otherwise(6.0), _upper_tail))

    high = F.size(F.filter(places, lambda y: y >= size / 2)).cast("double")
    runs = 1 + F.size(F.filter(steps, lambda s: (s["a"] >= size / 2) != (s["b"] >= size / 2)))

    def by_lag(mean: Column) -> Column:
        power = F.aggregate(places, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        lagged = F.aggregate(steps, F.lit(0.0), lambda a, s: a + (s["a"] - mean) * (s["b"] - mean))
        return _let(F.struct(power.alias("power"), lagged.alias("lagged")), lambda m: _let(F.when(m["power"] > 0, F.abs(m["lagged"] / m["power"] + 1 / n) * F.sqrt(n)).otherwise(6.0), _upper_tail))

    tails = F.struct(
        uniform.alias("uniform"), _let(F.struct(n.alias("n"), high.alias("high"), runs.alias("runs")), by_runs).alias("runs"),
        _let(F.aggregate(places, F.lit(0.0), lambda a, y: a + y) / n, by_lag).alias("serial"),
    )
    return _let(tails, lambda t: _let(_half_sum(t["uniform"], t["runs"], t["serial"]), lambda h: h - F.log(1 + h + h * h / 2)))


def _first(of: Column) -> Column:
    """The number of the first encoding whose pattern the token has, null for none."""
    return reduce(lambda rest, k: F.when(of.rlike(f"^(?:{ENCODINGS[k][0]})$"), k).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(None).cast("int"))


def measured(text: Column) -> Column:
    """The long tokens: s, e, letters n, misfit, and whether one may be a secret (open; else it is ordinary text)."""
    plain = F.transform(located(text, TOKEN), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.regexp_replace(F.translate(x["m"], "_", "/"), "-", "").alias("t")))
    typed = F.transform(plain, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), _first(x["t"]).alias("kind")))
    letters, opens = F.array(*[F.lit(e[1]) for e in ENCODINGS]), F.array(*[F.lit(e[2]).cast("boolean") for e in ENCODINGS])
    usable = F.filter(typed, lambda x: F.coalesce(opens[x["kind"]].isNotNull(), F.lit(False)) & (F.length(x["t"]) >= LEAST))
    placed = F.transform(usable, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), opens[x["kind"]].alias("open"), F.length(x["t"]).alias("n"), F.length(letters[x["kind"]]).cast("double").alias("k"), _let(letters[x["kind"]], lambda own: F.transform(F.filter(F.split(x["t"], ""), lambda c: c != ""), lambda c: (F.position(c, own) - 1).cast("double"))).alias("at")))
    return F.transform(placed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["n"].cast("double").alias("n"), misfit(x["at"], x["k"]).alias("misfit"), x["open"].alias("open")))


def ordinary(tokens: DataFrame) -> tuple[float, float]:
    """Mean and spread of the misfit by the letter, of a column tokens as measured() gives it and the prior's tokens."""
    m, n = F.col("t.misfit"), F.col("t.n")
    plain = tokens.select(F.explode("tokens").alias("t")).where(~F.col("t.open"))
    count, letters, total, squares = (x or 0 for x in plain.agg(F.count("*"), F.sum(n), F.sum(m), F.sum(m * m / n)).first())
    each, usual, apart = PRIOR
    count, letters, total, squares = count + ORDINARY, letters + ORDINARY * each, total + ORDINARY * each * usual, squares + ORDINARY * (apart**2 + usual**2 * each)
    mean = total / letters
    return mean, max(0.05, (max(0.0, squares - 2 * mean * total + mean * mean * letters) / count) ** 0.5)


def evidence(x: Column, plain: tuple[float, float]) -> Column:
    """The bin of a token's evidence: minus the logarithm of how probable so small a misfit is for ordinary text."""
    z = (x["misfit"] - plain[0] * x["n"]) / (plain[1] * F.sqrt(x["n"]))
    return F.least(F.floor(-F.log(_upper_tail(-z)) * BINS_EACH).cast("int"), F.lit(BINS))


def limit(tokens: DataFrame, plain: tuple[float, float], rate: float = RATE) -> int:
    """The least bin of evidence that counts as a secret, above all bins if none does."""
    bins = tokens.select(F.explode("tokens").alias("t")).where("t.open").groupBy(evidence(F.col("t"), plain).alias("bin")).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("bin"))
    ruled = bins.select("bin", F.sum("n").over(above).alias("found"), F.sum("n").over(Window.partitionBy()).alias("tests"))
    held = ruled.where(F.exp(-F.col("bin") / BINS_EACH) * F.col("tests") <= rate * F.col("found")).agg(F.min("bin")).first()[0]
    return BINS + 1 if held is None else held


def _found(docs: DataFrame, rate: float, own: list[str]) -> DataFrame:
    """The columns own of docs, and with names that no table bears their spans."""
    found = written(docs.select(*own, base_spans(F.col("text")).alias("__secret_base"), measured(F.col("text")).alias("__secret_tokens")), "secrets")
    tokens = found.select(F.col("__secret_tokens").alias("tokens"))
    plain = ordinary(tokens)
    most = limit(tokens, plain, rate)

    def accepted(x: Column) -> Column:
        return x["open"] & (evidence(x, plain) >= most)

    fresh = F.filter("__secret_tokens", lambda x: accepted(x) & ~F.exists("__secret_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return found.select(*own, F.array_sort(F.concat("__secret_base", _spans(fresh, 3))).alias("__secret_spans"), "__secret_base")


def scan(docs: DataFrame, rate: float = RATE, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep) with base and spans (s, kind, e: by start, then kind): random tokens that meet no base span join those."""
    own = docs.columns if keep is None else keep
    found = _found(docs, rate, own)
    return found.select(*[c for c in own if c not in ("spans", "base")], F.col("__secret_spans").alias("spans"), F.col("__secret_base").alias("base"))


def told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """docs with a mark in place of each secret; n_chars is counted anew, all other columns stay."""
    spans, text = F.col("__secret_spans"), F.col("text")
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def joined(a: Column, x: Column) -> Column:
        """Spans that overlap become one: the open one grows, or is put away for the next."""
        apart = x["s"] >= a["e"]
        put = F.when(apart, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"])
        return F.struct(F.when(apart, x["s"]).otherwise(a["s"]).alias("s"), F.greatest(a["e"], x["e"]).alias("e"), put.alias("out"))

    def marked(whole: Column) -> Column:
        edges = F.concat(whole, F.array(F.struct(F.length(text).alias("s"), F.length(text).alias("e"))))
        return F.array_join(F.zip_with(whole["e"], F.slice(edges["s"], 2, F.size(whole)), lambda e, s: F.substring(text, e + 1, s - e)), mark)

    # the first of the spans put away is the empty one at the start
    walked = _let(F.aggregate(spans, F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), none.alias("out")), joined, lambda a: F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))), marked)
    out = _found(docs, rate, docs.columns).withColumn("text", F.when(F.size(spans) > 0, walked).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op6_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
