"""Operator 2: quality rules whose cutoffs carry a guarantee.

Each rule rejects a document when a statistic of its whole text exceeds a cutoff. Per stratum a path of cutoffs is laid
from lax to strict and tested as a whole on labelled holdouts, so that all rules together reject at most `alpha` of the
stratum's good documents, with probability 1 - delta over all strata:

1. The path comes from documents that are not labelled good: of all (rule, cutoff), those that reject a greater share
   of the bad than of the rest, by the ratio of the two shares. Each step adds one to those before it.
2. The holdouts are the distinct texts labelled good, one trial each, since copies are no independent trials. A step
   passes if the exact (Clopper-Pearson) upper bound of the false rejection rate of all rules up to it is at most
   alpha. Steps are tested in order up to the first that fails (fixed sequence: no correction between steps), and the
   last that passed gives the cutoffs.
3. Strata are corrected for by Bonferroni: each is tested at delta divided by the number of strata that have enough
   holdouts for any test to pass, which their numbers tell and not their outcomes.

calibrate() instead tests every (rule, cutoff) of its own, corrected over all tests; it is far stricter and is used
with joint=False. Only counts by stratum are aggregated; each stratum's row is one row, however many documents it has.

Edge cases: null text has no words and fails the base rule; a null stratum is a stratum; strata without enough labels
have no cutoffs and keep all that pass the base rule; of several labels of a doc_id or text the least counts; repeated
rows get equal results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

_SYMBOL = re.compile(r"[#*$%&|<>]")
_SHOUT = re.compile(r"[!?]")
_WORD = re.compile(common.WORD)
#: Statistics, as SQL over the columns of measure(), and the cutoffs tried for each.
RULES = {
    "symbols_per_word": ("n_symbols / nullif(n_words, 0)", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "shouts_per_word": ("n_shouts / nullif(n_words, 0)", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "repeated_line_share": ("n_dup_lines / nullif(n_lines, 0)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "repeated_word_share": ("n_repeat_words / nullif(n_words, 0)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25)),
    "mean_word_length": ("word_chars / nullif(n_words, 0)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


def repeated_words(words: list[str], window: int) -> int:
    """Words within windows of `window` words that occur twice or more in the text, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # ranks of 1, 2, 4, ... words; a window is two stretches of the last power, which may overlap
    size = 1
    while size * 2 <= window:
        rank = np.unique(rank[:-size] * (len(words) + 1) + rank[size:], return_inverse=True)[1]
        size *= 2
    if size < window:
        rank = np.unique(rank[:n] * (len(words) + 1) + rank[window - size : window - size + n], return_inverse=True)[1]
    twice = (np.bincount(rank)[rank] > 1).astype(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_measures(text: str | None, window: int = 8) -> tuple[int, ...]:
    """MEASURES of a whole text."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words, window), len(lines), len(_SHOUT.findall(text)))


def measure(docs: DataFrame, stratum: str | None = None, window: int = 8) -> DataFrame:
    """(doc_id, stratum, *MEASURES, text_hash) per row of docs; stratum is the text of that column, or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_measures(t.as_py(), window) for t in batch.column(2)]
            columns = np.array(rows, np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(columns[:, i]) for i in range(len(MEASURES))], batch.column(3)], names=["doc_id", "stratum", *MEASURES, "text_hash"])

    by = F.col(stratum).cast("string") if stratum else F.lit("")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by.alias("stratum"), "text", F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in MEASURES) + ", text_hash long")


def upper_bound(r: int, n: int, level: float) -> float:
    """The exact upper bound of a rate of which r of n trials were seen, wrong with probability `level` at most.

    It is the p at which r or fewer of n have probability `level`; the regularised incomplete beta function gives
    that probability, by its continued fraction, and bisection finds p.
    """
    if n <= 0 or r >= n:
        return 1.0
    lo, hi = r / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - incomplete_beta(r + 1, n - r, mid) > level else (lo, mid)
    return hi


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


#: All (rule, statistic, cutoff).
TESTS = [(rule, value, cutoff) for rule, (value, cutoffs) in RULES.items() for cutoff in cutoffs]


def _labels(labels: DataFrame, label: str) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("good"))
    return known.where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))


def _bounds():
    @F.pandas_udf("double")
    def bound(r, n, level):
        return r.combine(n, lambda a, b: (a, b)).combine(level, lambda ab, c: upper_bound(int(ab[0]), int(ab[1]), float(c)))

    return bound


def calibrate(measured: DataFrame, labels: DataFrame, *, alpha: float = 0.05, delta: float = 0.05, label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, rejected_good, n_good, bound, rejected_bad, n_bad): the chosen cutoffs."""
    rows = measured.where("not base_failed").join(_labels(labels, label), "doc_id")
    tests = TESTS
    over = [F.struct(*[F.count_if(F.expr(f"good = {g} and {value} > {cutoff}")).alias(f"r{g}") for g in (0, 1)], F.lit(rule).alias("rule"), F.lit(float(cutoff)).alias("cutoff")) for rule, value, cutoff in tests]
    counts = rows.groupBy("stratum").agg(F.count_if(F.expr("good = 1")).alias("n_good"), F.count_if(F.expr("good = 0")).alias("n_bad"), F.array(*over).alias("tests"))
    flat = counts.withColumn("strata", F.count("*").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).select("stratum", "n_good", "n_bad", "strata", F.explode("tests").alias("t"))
    flat = flat.select("stratum", "t.rule", "t.cutoff", F.col("t.r1").alias("rejected_good"), "n_good", F.col("t.r0").alias("rejected_bad"), "n_bad", _bounds()("t.r1", "n_good", F.lit(delta / len(tests)) / F.col("strata")).alias("bound"))
    gain = F.col("rejected_bad") / F.greatest("n_bad", F.lit(1)) - F.col("rejected_good") / F.greatest("n_good", F.lit(1))
    best = W.partitionBy("stratum", "rule").orderBy(F.col("gain").desc(), F.col("cutoff").desc())
    passed = flat.withColumn("gain", gain).where((F.col("bound") <= alpha / len(RULES)) & (F.col("gain") > 0))
    return passed.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "gain")


def path_of(share_bad: list[float], share_rest: list[float]) -> list[int]:
    """The numbers in TESTS of a stratum's steps, lax to strict: those that reject more of the bad than of the rest, by the ratio of shares.

    A step that a cutoff of its rule before it already covers is left out. Equal ratios go by the greater share of the
    bad, then by number.
    """
    gains = [i for i in range(len(TESTS)) if share_bad[i] > share_rest[i]]
    gains.sort(key=lambda i: (-share_bad[i] / max(share_rest[i], 1e-12), -share_bad[i], i))
    least: dict[str, float] = {}
    steps = []
    for i in gains:
        rule, _, cutoff = TESTS[i]
        if cutoff < least.get(rule, math.inf):
            least[rule] = cutoff
            steps.append(i)
    return steps


def calibrate_jointly(measured: DataFrame, labels: DataFrame, *, alpha: float = 0.05, delta: float = 0.05, label: str = "quality") -> DataFrame:
    """(stratum, step, n_good, rejected_good, bound, one cutoff or null per rule): the last step that passed, per stratum that has one."""
    rows = measured.where("not base_failed").join(_labels(labels, label), "doc_id", "left")
    texts = rows.groupBy("stratum", "text_hash").agg(F.min("good").alias("good"), *[F.first(m).alias(m) for m in MEASURES])
    texts = common.written(texts, "rules-texts")
    hits = F.array(*[F.coalesce(F.expr(f"{value} > {cutoff}"), F.lit(False)).cast("int") for _, value, cutoff in TESTS])
    sums = lambda among: F.array(*[F.sum(F.when(F.expr(among), F.get("hits", i)).otherwise(0)) for i in range(len(TESTS))])
    counts = texts.withColumn("hits", hits).groupBy("stratum").agg(F.count_if(F.expr("good = 0")).alias("n_bad"), F.count_if(F.expr("good is null")).alias("n_rest"), sums("good = 0").alias("bad"), sums("good is null").alias("rest"), F.count_if(F.expr("good = 1")).alias("n_good"))

    @F.pandas_udf("array<int>")
    def path(bad, n_bad, rest, n_rest):
        return bad.combine(n_bad, lambda b, n: [x / max(n, 1) for x in b]).combine(rest.combine(n_rest, lambda r, n: [x / max(n, 1) for x in r]), path_of)

    paths = common.written(counts.select(F.col("stratum").alias("s"), "n_good", path("bad", "n_bad", "rest", "n_rest").alias("path")), "rules-paths")
    # Strata of which any step could pass at level delta; their number corrects the level.
    able = max(paths.where(F.col("n_good") >= math.log(delta) / math.log1p(-alpha)).count(), 1)
    held = texts.where("good = 1").withColumn("hits", hits).join(paths.drop("n_good"), F.col("stratum").eqNullSafe(F.col("s")))
    first = F.array_position(F.transform("path", lambda i: F.get(F.col("hits"), i)), 1)
    rejected = held.groupBy("stratum", first.alias("step")).agg(F.count("*").alias("n"))
    steps = paths.select(F.col("s").alias("stratum"), "n_good", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("step")).where("size(path) > 0")
    steps = steps.join(rejected.withColumnsRenamed({"stratum": "s", "step": "k"}), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("step") == F.col("k")), "left")
    upto = W.partitionBy("stratum").orderBy("step")
    steps = steps.withColumn("rejected_good", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    steps = steps.withColumn("bound", _bounds()("rejected_good", "n_good", F.lit(delta / able)))
    steps = steps.withColumn("failed", F.max((F.col("bound") > alpha).cast("int")).over(upto)).where("failed = 0")
    last = steps.groupBy("stratum").agg(F.max(F.struct("step", "n_good", "rejected_good", "bound", "path")).alias("x")).select("stratum", "x.*")
    taken = F.slice("path", F.lit(1), F.col("step"))
    of_rule = lambda rule: F.array(*[F.when(F.lit(t[0] == rule), F.lit(float(t[2]))) for t in TESTS])
    own = lambda rule: F.array_min(F.transform(taken, lambda i: F.get(of_rule(rule), i)))  # noqa: E731  nulls don't count
    cutoff = {rule: own(rule) for rule in RULES}
    return last.select("stratum", "step", "n_good", "rejected_good", "bound", *[c.alias(rule) for rule, c in cutoff.items()])


def apply_rules(docs: DataFrame, labels: DataFrame, *, stratum: str | None = "lang", window: int = 8, least_words: int = 20, most_repeated: int = 30, joint: bool = True, **options) -> DataFrame:
    """Per row of docs: doc_id, the measures, base_failed, kept, rejected_by (the rules that reject it)."""
    base = F.expr(f"n_words < {least_words} or 100 * n_repeat_words > {most_repeated} * n_words")
    measured = common.written(measure(docs, stratum, window).withColumn("base_failed", base), "rules-measures")
    chosen = calibrate_jointly(measured, labels, **options).select("stratum", *RULES) if joint else calibrate(measured, labels, **options).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    cutoffs = common.written(chosen.withColumnRenamed("stratum", "_s"), "rules-cutoffs")
    tested = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    hit = [F.when(F.expr(f"{value} > {rule}"), F.lit(rule)) for rule, (value, _) in RULES.items()]
    out = tested.withColumn("rejected_by", F.array_compact(F.array(*hit)))
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
