"""Secret scanning with a randomness test battery, in DataFrame operations only.

Known shapes are found by pattern. Other long tokens get their encoding inferred and go through three
tests over its alphabet: chi-squared uniformity, runs and lag-one correlation. Each test has two sides.
Against randomness: a token that fails any of them is no secret. Against text: each statistic is scored
by the null of text-like tokens of the same encoding and length (composition, changes between kinds of
characters, alternation of vowels), and the three scores together give one p-value. Benjamini-Hochberg
within bands of length controls the false discoveries among all tested tokens, since short tokens
carry little evidence. Everything is done within the row but for one histogram of p-values.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.storage import written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern of its matches, in reporting order. Runs are maximal, so a least length in the
#: pattern finds the same matches as a check of each whole run.
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
MIN_VALUE = 6
TOKEN = r"[A-Za-z0-9+/_-]{16,}"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the narrowest: name, pattern of a whole token, alphabet.
ENCODINGS = (
    ("hex", r"\A(?:[0-9a-f]+|[0-9A-F]+)\z", _DIGITS + "abcdef"),
    ("base32", r"\A[A-Z2-7]+\z", _UPPER + "234567"),
    ("base36", r"\A(?:[0-9a-z]+|[0-9A-Z]+)\z", _DIGITS + _LOWER),
    ("base62", r"\A[0-9A-Za-z]+\z", _DIGITS + _LOWER + _UPPER),
    ("base64", r"\A[0-9A-Za-z+/]+\z", _DIGITS + _LOWER + _UPPER + "+/"),
    ("base64url", r"", _DIGITS + _LOWER + _UPPER + "-_+/"),
)
#: Frequencies of letters in English text, per cent: fixed values.
LETTERS = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}
#: Part of the letter frequencies that is spread evenly: names and other languages use rare letters more.
EVEN = 0.2
#: Shares of lower-case letters, capitals, digits and signs in text-like tokens: words, words in capitals, and ids of digits.
WORDS, CAPITALS, IDS = (0.80, 0.10, 0.04, 0.06), (0.10, 0.80, 0.04, 0.06), (0.12, 0.12, 0.88, 0.0)
#: By encoding: the nulls of text, and how often the kind of character changes in it. The least favourable null counts.
TEXT = {
    "hex": ((WORDS, IDS), 0.15), "base32": ((WORDS, IDS), 0.10), "base36": ((WORDS, IDS), 0.10),
    "base62": ((WORDS, CAPITALS), 0.30), "base64": ((WORDS, CAPITALS), 0.30), "base64url": ((WORDS, CAPITALS), 0.33),
}
VOWELS = "[AEIOUYaeiouy]"
#: Lag-one correlation of vowels in text: they alternate with consonants.
ALTERNATION = -0.3
#: Spread of the sum of the three scores under text; the square root of 3 if they were independent and normal.
SPREAD = 1.85
#: Lower ends of the bands of length.
BANDS = (16, 24, 32, 48, 80)
FALSE_DISCOVERIES = 0.05
#: Scores at p = 0.001, one-sided and two-sided: beyond them a token is not random.
Z_ONE, Z_TWO = 3.0902, 3.2905
#: Steps of log10 p in the histogram, and its range.
STEPS, DEPTH = 20, 30


SPAN = "array<struct<start:int,end:int,match:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of leftmost non-overlapping matches; code points, end exclusive.

    Offsets are summed up in blocks of about the square root of their number, so that the work and the
    copies stay near linear in texts with many matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def block(xs: Column) -> Column:
        """(out: spans from the block's first character, at: where it ends)."""
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["match"])
            return F.struct(F.coalesce(end, start).alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))))).alias("out"))

        return F.aggregate(xs, begin, step)

    def placed(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), lambda b, at: F.transform(b["out"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["match"].alias("match"))))
        return F.flatten(moved)

    def all_of(xs: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda i: block(F.slice(xs, i * width + 1, width)))
        return F.transform(F.array(blocks), placed)[0]

    found = F.transform(F.array(pairs), all_of)[0]  # a lambda variable, so that the matches are cut once
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _tail(z: Column) -> Column:
    """P(N < -z) for z >= 0, and 1 - that otherwise, by a rational approximation."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _weights(alphabet: str, shares: tuple[float, float, float, float]) -> tuple[list[float], float, float]:
    """(log-likelihood ratio of randomness to text of each character, its mean and deviation in text)."""
    even = EVEN / len(LETTERS)
    whole = sum(LETTERS.values())
    p = []
    for c in alphabet:
        kind = next(i for i, test in enumerate((str.islower, str.isupper, str.isdigit, lambda _: True)) if test(c))
        letter = (1 - EVEN) * LETTERS[c.lower()] / whole + even if c.isalpha() else 1 / sum(1 for x in alphabet if x.isdigit() == c.isdigit() and not x.isalpha())
        if shares is IDS and c.isalpha():
            letter = 1 / sum(map(str.isalpha, alphabet))
        p.append(shares[kind] * letter)
    total = sum(p)
    p = [x / total or 1e-12 for x in p]
    ratio = [log(1 / len(alphabet) / x) for x in p]
    mean = sum(x * r for x, r in zip(p, ratio, strict=True))
    return ratio, mean, sqrt(sum(x * r * r for x, r in zip(p, ratio, strict=True)) - mean * mean)


def _battery(name: str, alphabet: str, tok: Column) -> Column:
    k, n = float(len(alphabet)), F.length(tok).cast("double")
    squares = F.aggregate(F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(tok, c, F.lit(""))), F.lit(2.0)))
    chi = squares * k / n - n
    df = k - 1
    z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    nulls, changes = TEXT[name]
    codes = F.transform(F.split(tok, "(?!^)"), lambda c: F.instr(F.lit(alphabet), c))

    def composition(shares: tuple[float, float, float, float]) -> Column:
        ratio, mean, spread = _weights(alphabet, shares)
        table = F.array(*[F.lit(float(r)) for r in ratio])
        return (F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.element_at(table, c)) - n * mean) / (F.sqrt(n) * spread)

    kinds = F.translate(tok, _DIGITS + _LOWER + _UPPER + "+/-_", "0" * 10 + "a" * 26 + "A" * 26 + "----")
    moves = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    z_moves = (moves - (n - 1) * changes) / F.sqrt((n - 1) * (changes * (1 - changes)))
    vowels = n - F.length(F.regexp_replace(tok, VOWELS, ""))
    share, ends = vowels / n, tok.rlike("^" + VOWELS).cast("double") + tok.rlike(VOWELS + "$").cast("double")
    together = vowels - F.regexp_count(tok, F.lit(VOWELS + "+"))  # adjacent pairs of vowels
    cov = together - share * (2 * vowels - ends) + (n - 1) * share * share
    z_vowels = F.when((vowels > 0) & (vowels < n), (cov / (vowels * (1 - share)) - ALTERNATION) * F.sqrt(n)).otherwise(0.0)
    z_text = (F.least(*[composition(x) for x in nulls]) + z_moves + z_vowels) / SPREAD
    return F.struct(F.lit(name).alias("encoding"), n.alias("n"), F.lit(k).alias("k"), z_chi.alias("z_chi"), _tail(z_text).alias("p_text"), F.transform(codes, lambda c: c.cast("double")).alias("codes"))


def randomness(token: Column) -> Column:
    """struct<encoding, n, z_chi, p_text, z_runs, z_serial> of a token.

    z_chi: Wilson-Hilferty score of the chi-squared statistic, large if not uniform. z_runs and
    z_serial are two-sided. p_text: chance that a text-like token of this encoding and length looks as
    random in composition, runs of kinds and alternation of vowels, by the least favourable null.
    """
    out = _battery(ENCODINGS[-1][0], ENCODINGS[-1][2], token)
    for name, pattern, alphabet in reversed(ENCODINGS[:-1]):
        folded = F.lower(token) if name in ("hex", "base36") else token
        out = F.when(token.rlike(pattern), _battery(name, alphabet, folded)).otherwise(out)

    def sequence_tests(b: Column) -> Column:
        n, codes = b["n"], b["codes"]
        high = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + (x > b["k"] / 2).cast("double"))
        nexts = F.slice(codes, 2, F.size(codes))
        pairs = F.filter(F.zip_with(codes, nexts, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["y"].isNotNull())
        runs = F.aggregate(pairs, F.lit(1.0), lambda acc, p: acc + ((p["x"] > b["k"] / 2) != (p["y"] > b["k"] / 2)).cast("double"))
        expected = 2 * high * (n - high) / n
        spread = F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9)))
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x) / n
        var = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        cov = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - mean) * (p["y"] - mean))
        return F.struct(b["encoding"].alias("encoding"), n.alias("n"), b["z_chi"].alias("z_chi"), b["p_text"].alias("p_text"), ((runs - 1 - expected) / spread).alias("z_runs"), ((cov / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).alias("z_serial"))

    return F.transform(F.array(out), sequence_tests)[0]


def _band(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS[1:], 1):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _depth(p: Column) -> Column:
    return F.floor(F.least(F.lit(float(DEPTH)), -F.log10(F.greatest(p, F.lit(1e-300)))) * STEPS).cast("int")


def discoveries(candidates: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """band -> least depth of p that is a discovery, from columns band and depth.

    Benjamini-Hochberg on the histogram: a whole step counts with its largest p. The driver sees at
    most len(BANDS) * STEPS * DEPTH counts.
    """
    bands: dict[int, dict[int, int]] = {}
    for band, depth, n in candidates.groupBy("band", "depth").count().collect():
        bands.setdefault(band, {})[depth] = n
    out = {}
    for band, hist in bands.items():
        total, above = sum(hist.values()), 0
        for depth in sorted(hist, reverse=True):
            above += hist[depth]
            if 10 ** (-depth / STEPS) <= rate * above / total:
                out[band] = depth
    return out


def _kind(found: Column, order: int, kind: str) -> Column:
    if kind == "assign":
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= MIN_VALUE)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per row of docs: id_col, base and spans: array<struct<kind, start, end>> by start, then kind.

    base: matches of the BASE patterns. spans: those and ``random`` spans that overlap none of them.
    Null text counts as empty, which has no spans. Rows are judged alone, but for the discovery
    threshold, which is the same whatever the order of rows. Texts may be of any length and hold any
    number of matches; rows equal in everything are judged each. Tokens of 16 characters and more are
    tested, whatever kinds of characters they hold. No rows in, no rows out.
    """
    empty = "array<struct<start:int,ord:int,end:int,kind:string>>"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [_kind(matches(F.col("text"), pattern), i, kind) for i, (kind, pattern) in enumerate(BASE.items())]
    based = rows.withColumn("base", F.array_sort(F.concat(*kinds).cast(empty)))
    tokens = F.filter(matches(F.col("text"), TOKEN), lambda m: ~F.exists(F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    tested = F.transform(tokens, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), randomness(m["match"]).alias("t")))
    random_ = lambda c: (c["t"]["z_chi"] <= Z_ONE) & (F.abs(c["t"]["z_runs"]) <= Z_TWO) & (F.abs(c["t"]["z_serial"]) <= Z_TWO)
    # a token that is not random counts with p = 1, that is depth 0
    shaped = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _band(c["t"]["n"]).alias("band"), F.when(random_(c), _depth(c["t"]["p_text"])).otherwise(0).alias("depth"))
    slim = written(based.withColumn("tested", tested).select("id", "base", F.transform("tested", shaped).alias("tested")), "secret-candidates")
    least = discoveries(slim.select(F.explode("tested").alias("c")).select("c.band", "c.depth"), rate)
    limit = lambda band: F.coalesce(*[F.when(band == b, d) for b, d in least.items()], F.lit(1 << 20))
    random = F.transform(F.filter("tested", lambda c: c["depth"] >= limit(c["band"])), lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("ord"), c["end"].alias("end"), F.lit("random").alias("kind")))
    out = slim.select("id", "base", F.array_sort(F.concat(F.col("base"), random.cast(empty))).alias("spans"))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return out.select(F.col("id").alias(id_col), F.transform("base", plain).alias("base"), F.transform("spans", plain).alias("spans"))
