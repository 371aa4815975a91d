"""URL verdicts by rules and, beyond them, by a character language-model ratio; DataFrame operations only.

Two smoothed variable-order Markov models (orders 0 to 2, Witten-Bell interpolation: the longer
context counts for more the better it is known) are counted from URLs that the rules accept or
reject. A URL's score is the difference of its log-likelihoods under them, divided by its length.
About one labelled URL in four (by a hash of it, so equal ones stay together) is held out of the counts, and the threshold is
calibrated on these, at the best balanced accuracy. Counts cover all other labelled rows; they are at most
ALPHABET ** 3 by class, so the finished model is a literal of bounded size.

Defined cases: a null URL, or one without ``://``, has empty host and path, no rule, and a verdict by
its characters (a null one: of the empty string, whose score is 0); one with a host alone fits no rule, as its path doesn't begin with
``/``; with only one labelled class to learn from, or none, every score is 0, and with only one held out, or none, the threshold
is 0; ties go to ``allow``; a very long URL is scored whole; repeated rows each get a row; an empty table gives an empty result; columns
that clash with the added ones, and all others, are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed alphabet: letters, one digit class, the usual marks, start, and one class for all else.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
MARKS = "0/.-_:?=&%#+~@"
SYMBOLS = LETTERS + MARKS
START = len(SYMBOLS)
OTHER = len(SYMBOLS) + 1
ALPHABET = len(SYMBOLS) + 2
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Scores are kept as whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
BINS = 2000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z are lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LETTERS)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules are (``host/path``, verdict)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _codes(url: Column) -> Column:
    """The URL as an array of symbol numbers, after two start symbols."""
    s = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LETTERS + "0" * 9)
    chars = F.split(s, "")
    code = lambda c: F.when(c == "", F.lit(None)).otherwise(F.coalesce(F.nullif(F.instr(F.lit(SYMBOLS), c), F.lit(0)) - 1, F.lit(OTHER)))
    body = F.filter(F.transform(chars, code), lambda x: x.isNotNull())
    return F.concat(F.array(F.lit(START), F.lit(START)), body)


def _grams(codes: Column) -> Column:
    """Every (two symbols of context, next symbol) as one number."""
    cell = lambda cs: F.transform(
        F.slice(cs, F.lit(3), F.greatest(F.size(cs) - 2, F.lit(0))),
        lambda c, i: (F.element_at(cs, i + 1) * ALPHABET + F.element_at(cs, i + 2)) * ALPHABET + c,
    )
    # Bound as a lambda variable, ``codes`` is computed once per row and not once per symbol.
    return F.get(F.transform(F.array(codes), cell), F.lit(0))


def _witten_bell(counts: dict[int, int]) -> list[float]:
    """log P(next | two symbols) for all ALPHABET ** 3 cells."""
    a = ALPHABET
    by0, by1 = [0] * a, {}
    by2: dict[int, dict[int, int]] = {}
    for g, n in counts.items():
        c = g % a
        by0[c] += n
        one = by1.setdefault(g // a % a, {})
        one[c] = one.get(c, 0) + n
        by2.setdefault(g // a, {})[c] = n

    def mix(seen: dict[int, int], lower: list[float]) -> list[float]:
        n, kinds = sum(seen.values()), len(seen)
        return [(seen.get(c, 0) + kinds * lower[c]) / (n + kinds) for c in range(a)]

    zero = mix({c: n for c, n in enumerate(by0) if n} or {0: 1}, [1 / a] * a)
    first = [mix(by1[k], zero) if k in by1 else zero for k in range(a)]
    out: list[float] = []
    for ctx in range(a * a):
        row = mix(by2[ctx], first[ctx % a]) if ctx in by2 else first[ctx % a]
        out += map(math.log, row)
    return out


def fit(df: DataFrame, url_col: str = "url", label_col: str = "verdict") -> list[int]:
    """log P_accepted - log P_rejected of each cell in whole 1/UNIT, from rows labelled allow or block."""
    grams = df.filter(F.col(label_col).isin("allow", "block")).select(
        F.col(label_col).alias("label"), F.explode(_grams(_codes(F.col(url_col)))).alias("gram")
    )
    counts: dict[str, dict[int, int]] = {"allow": {}, "block": {}}
    for r in grams.groupBy("label", "gram").count().collect():  # at most 2 * ALPHABET ** 3 rows
        counts[r["label"]][r["gram"]] = r["count"]
    if not counts["allow"] or not counts["block"]:
        return [0] * ALPHABET**3
    good, bad = _witten_bell(counts["allow"]), _witten_bell(counts["block"])
    return [round((x - y) * UNIT) for x, y in zip(good, bad, strict=True)]


def score(url: Column, weights: list[int]) -> Column:
    """Length-normalised log-likelihood difference in whole 1/UNIT (rounded towards zero)."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    mean = lambda g: F.try_divide(
        F.aggregate(g, F.lit(0).cast("bigint"), lambda s, x: s + F.get(table, x.cast("int"))), F.size(g)
    )
    return F.coalesce(F.get(F.transform(F.array(_grams(_codes(url))), mean), F.lit(0)), F.lit(0.0))


def calibrate(scored: DataFrame, label_col: str = "verdict", score_col: str = "score") -> float:
    """The bin edge with the best balanced accuracy on labelled rows (0 if a class is missing)."""
    width = 8 * UNIT / BINS
    bins = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col(score_col) + 4 * UNIT) / width)))
    rows = scored.filter(F.col(label_col).isin("allow", "block")).groupBy(bins.alias("bin"), label_col).count().collect()
    n = {"allow": [0] * BINS, "block": [0] * BINS}
    for r in rows:  # at most 2 * BINS
        n[r[label_col]][r["bin"]] = r["count"]
    good, bad = sum(n["allow"]), sum(n["block"])
    if not good or not bad:
        return 0.0
    best, at, below_good, below_bad = -1.0, 0.0, 0, 0
    for b in range(BINS):
        below_good += n["allow"][b]
        below_bad += n["block"][b]
        balanced = (1 - below_good / good) + below_bad / bad
        if balanced > best + 1e-12:
            best, at = balanced, (b + 1) * width - 4 * UNIT
    return at


def held_out(url: Column) -> Column:
    """One URL in four, by the first digit of its md5."""
    return F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 1) < "4"


def judge(df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score."""
    url = F.col(url_col).cast("string")
    base = df.select(F.col(id_col), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = base.select("*", name.alias("rule"), verdict.alias("verdict"))
    weights = fit(ruled.filter(~held_out(F.col("_url"))), "_url")
    scored = ruled.withColumn("score", score(F.col("_url"), weights))
    threshold = calibrate(scored.filter(held_out(F.col("_url"))))
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        id_col, "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), (F.col("score") / UNIT).alias("score")
    )
