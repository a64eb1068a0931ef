"""Secret scan by a randomness test battery.

Base spans are the three fixed patterns. The method adds tokens that look random: a run of token
characters whose characters name an encoding (hex, base32, base36 or base64) is tested for
chi-squared uniformity over the encoding's alphabet, for runs above and below the middle of the
alphabet, and for lag-1 serial correlation. Fisher's method joins the three p-values of "drawn
uniformly at random". Structured tokens are the discoveries of a Benjamini-Hochberg test within
each band of encoding and length (bands, as the tests' power grows with the length); a token that
isn't discovered is reported as random. A token must be long enough for uniformity to be testable:
``MIN_BITS`` of the encoding's entropy.

Everything is DataFrame functions. One pass extracts spans and test results per document and is
written to the shared folder without texts; the p-values are counted there per band and value on a
logarithmic grid (at most 300 ``P_STEPS`` rows a band), whatever the corpus' size.

Nulls and empty texts have no spans. Repeated rows each give their own row, and each counts in the
bands. Other columns are left out of the result; their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setscore.llm import spans as S
from setscore.llm.common import materialise, table

# The base patterns. Runs of one character class are matched at their begin only,
# with the least length in the pattern, as no other place in the run can match.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
# '=' is padding at a token's end only, so the value of name=value is a token of its own
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
KEYWORD = "(?i)password|passwd|secret|token|api_?key"
KINDS = ["assign", "access", "hex", "random"]

# Encodings by the characters a token may have and must have, with their alphabets.
DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPERS + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWERS),
    ("BASE36", "^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPERS),
    ("base64", "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*$", UPPERS + LOWERS + DIGITS + "+/"),
]
MIN_BITS = 80            # least entropy of a reported token, as a random string of its encoding
P_STEPS = 100            # steps of a power of ten that p-values are rounded up to for the band counts
P_LEAST = 1e-300
LEVEL = 0.05             # false-discovery rate of "structured" within a band


def upper_tail(z: Column) -> Column:
    """1 - Phi(z): Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(body: Column, alphabet: Column) -> Column:
    """Joint p-value of a token's three tests of uniform random characters."""
    n = F.length(body).cast("double")
    k = F.length(alphabet).cast("double")
    chars = F.split(body, "")
    at = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double"))
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0),
                          lambda acc, c: acc + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2)))
    chi2 = squares * k / n - n
    df = k - 1
    # Wilson and Hilferty's normal form of chi-squared
    p_chi = upper_tail((F.pow(F.greatest(chi2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    def walk(acc: Column, x: Column) -> Column:
        high = x > k / 2
        return F.struct(
            F.when(acc["runs"] == 0, F.lit(1)).otherwise(acc["runs"] + (high != (acc["last"] > k / 2)).cast("int")).alias("runs"),
            (acc["high"] + high.cast("double")).alias("high"), (acc["s"] + x).alias("s"), (acc["ss"] + x * x).alias("ss"),
            (acc["lag"] + acc["last"] * x).alias("lag"),
            F.when(acc["runs"] == 0, x).otherwise(acc["first"]).alias("first"), x.alias("last"))

    zero = F.lit(0.0)
    w = F.struct(F.lit(0).alias("runs"), *[zero.alias(c) for c in ("high", "s", "ss", "lag", "first", "last")])

    def finish(a: Column) -> Column:
        low = n - a["high"]
        mean = 2 * a["high"] * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(var <= 0, zero).otherwise(2 * upper_tail(F.abs(a["runs"] - mean) / F.sqrt(var)))
        centre = a["s"] / n
        spread = a["ss"] - n * centre * centre
        lag = a["lag"] - centre * (2 * a["s"] - a["first"] - a["last"]) + (n - 1) * centre * centre
        p_lag = F.when(spread <= 1e-9, zero).otherwise(2 * upper_tail(F.abs(lag / spread * F.sqrt(n) + 1 / F.sqrt(n))))
        x = F.lit(0.0)
        for p in (p_chi, p_runs, p_lag):
            x = x - 2 * F.log(F.greatest(p, F.lit(1e-300)))
        return F.exp(-x / 2) * (1 + x / 2 + x * x / 8)           # chi-squared tail, 6 degrees of freedom

    return F.aggregate(at, w, walk, finish)


def _base_spans(text: Column) -> Column:
    yes = lambda m: F.lit(True)
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return F.concat(
        S.match_spans(text, ASSIGN, 0, "assign", long_value, text.rlike(KEYWORD)),
        S.match_spans(text, ACCESS, 1, "access", yes, F.contains(text, F.lit("AKIA"))),
        S.match_spans(text, HEX, 2, "hex", yes, text.rlike(HEX)))


def _tested(tokens: Column) -> Column:
    """Tokens with an inferred encoding and enough characters: place, band and joint p-value."""
    def one(s: Column) -> Column:
        name, alphabet = F.lit(None).cast("string"), F.lit("")
        for label, pattern, letters in reversed(ENCODINGS):
            fits = s["value"].rlike(pattern)
            name, alphabet = F.when(fits, F.lit(label)).otherwise(name), F.when(fits, F.lit(letters)).otherwise(alphabet)
        body = F.translate(F.rtrim(s["value"], F.lit("=")), "-_", "+/")
        return F.struct(s.alias("span"), name.alias("encoding"), alphabet.alias("alphabet"), body.alias("body"))

    inferred = F.filter(F.transform(tokens, one), lambda t: t["encoding"].isNotNull()
                        & (F.length(t["body"]) * F.log2(F.length(t["alphabet"])) >= MIN_BITS))
    return F.transform(inferred, lambda t: F.struct(
        t["span"].alias("span"),
        F.concat(t["encoding"], F.lit(":"), F.floor(F.log2(F.length(t["body"]))).cast("string")).alias("band"),
        rounded_up(battery(t["body"], t["alphabet"])).alias("p")))


def rounded_up(p: Column) -> Column:
    """p on a logarithmic grid, down to P_LEAST: at most 2.4 % more, however small."""
    return F.least(F.lit(1.0), F.pow(F.lit(10.0), F.ceil(F.log10(F.greatest(p, F.lit(P_LEAST))) * P_STEPS) / P_STEPS))


def band_cuts(tested: DataFrame) -> DataFrame:
    """(band, cut): the Benjamini-Hochberg cut of each band that has one; p <= cut is structured.

    ``tested`` has the columns band and p, one row per token.
    """
    counts = tested.groupBy("band", "p").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("band").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"rank": F.sum("c").over(up), "m": F.sum("c").over(Window.partitionBy("band"))})
    return (ranked.where(F.col("p") <= LEVEL * F.col("rank") / F.col("m"))
                  .groupBy("band").agg(F.max("p").alias("cut")))


def secret_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, with base (base spans by start) and extra (random tokens beside them)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    found = docs.select(kept, text.alias("text")).select(
        "row", S.by_start(_base_spans(F.col("text"))).alias("base"),
        S.match_spans(F.col("text"), TOKEN, 3, "random", lambda m: m.rlike("[0-9]"), F.col("text").rlike(TOKEN)).alias("tokens"))
    found = found.select("row", "base", S.beside(F.col("tokens"), F.col("base")).alias("tokens"))
    found = materialise(found.select("row", "base", _tested(F.col("tokens")).alias("tested")), "secrets")
    cuts = band_cuts(found.select(F.explode("tested").alias("t")).select("t.band", "t.p"))
    # at most encodings x length powers of two entries
    by_band = cuts.agg(F.map_from_entries(F.collect_list(F.struct("band", "cut"))).alias("cuts")).scalar()
    out = found.withColumn("cuts", by_band)
    random = F.filter("tested", lambda t: t["p"] > F.coalesce(F.try_element_at(F.col("cuts"), t["band"]), F.lit(0.0)))
    return out.select("row.*", "base", F.transform(random, lambda t: t["span"]).alias("extra"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every secret replaced by its kind in brackets; null stays null."""
    found = secret_spans(docs, keep=("doc_id", "text"))
    word = lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))
    return found.select("doc_id", S.replaced(F.col("text"), F.concat("base", "extra"), word).alias("text"))


def op3_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    every = S.by_start(F.concat("base", "extra"))
    return found.select("doc_id", *[S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(every).alias("spans"),
                        F.size("extra").cast("long").alias("n_random"))


QUERIES = {"op3_random_secrets": op3_random_secrets}
