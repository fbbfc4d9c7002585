from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import edges as E
from lodegraph.functions import text as T
from lodegraph.functions import values as V

EDGE = "is_current boolean, valid_until string, last_seen string, refresh_cycle_days int, confidence double, corroboration long, suspect boolean, stage1 string"


@pytest.fixture
def of(spark):
    def run(function, *values, kind="string"):
        names = [chr(97 + i) for i in range(len(values))]
        schema = ", ".join(f"{n} {kind}" for n in names)
        return spark.createDataFrame([values], schema).select(function(*[F.col(n) for n in names]).alias("x")).first().x

    return run


@pytest.mark.parametrize(
    ("current", "until", "seen", "cycle", "status", "factor"),
    [
        (False, None, "2024-06-01", 180, "expired", 0.3),
        (True, "2024-05-31", "2024-06-01", 180, "expired", 0.3),
        (True, "2024-06-01", "2024-06-01", 180, "current", 1.0),
        (None, None, None, 180, "unknown", 0.7),
        (True, None, "2020-01-01", None, "current", 1.0),
        (True, None, "2020-01-01", 0, "current", 1.0),
        (True, None, "2024-02-22", 100, "current", 1.0),
        (True, None, "2024-01-03", 100, "current", 1.0),
        (True, None, "2024-01-02", 100, "stale", 0.6),
        (True, None, "not a date", 100, "unknown", 0.7),
        (True, "garbage", "2024-06-01", 100, "current", 1.0),
    ],
)
def test_freshness_truth_table(spark, current, until, seen, cycle, status, factor):
    df = spark.createDataFrame([(current, until, seen, cycle, 0.9, 1, False, None)], EDGE)
    r = df.withColumns(E.assess("2024-06-01")).first()
    assert (r.status, r.factor) == (status, factor)


@pytest.mark.parametrize(
    ("confidence", "corroboration", "suspect", "stage1", "verdict", "score"),
    [
        (0.9, 1, None, None, "supported", 0.9),
        (None, None, False, None, "supported", 0.7),
        (0.0, 3, False, None, "supported", 0.7 * 1.1),
        (0.5, 50, False, None, "supported", 0.5 * 1.2),
        (0.8, 1, True, "wrong_type", "wrong_type", 0.4),
        (0.8, 1, True, "", "unfounded", 0.8),
        (0.8, 1, True, None, "unfounded", 0.8),
    ],
)
def test_verdict_and_score(spark, confidence, corroboration, suspect, stage1, verdict, score):
    df = spark.createDataFrame([(True, None, "2024-06-01", 0, confidence, corroboration, suspect, stage1)], EDGE)
    r = df.withColumns(E.assess("2024-06-01")).withColumn("verdict", E.verdict()).withColumn("score", E.score()).first()
    assert r.verdict == verdict
    assert r.score == pytest.approx(score)


@pytest.mark.parametrize(
    ("a", "b"),
    [("㈜한빛", "주식회사 한빛"), ("Acme Co., Ltd.", "ACME"), ("Acme, Inc", "acme inc."), ("한빛(주1)", "한빛")],
)
def test_company_keys_meet(of, a, b):
    assert of(lambda x, y: T.company_key(x) == T.company_key(y), a, b)


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "a b-c", 1.0), ("", "x", 0.0), ("ab", "abcdefgh", 0.0), ("전자", "한빛전자", 0.9), ("전자", "빛전자", 0.0)])
def test_registry_similarity(of, a, b, want):
    assert of(T.registry_similarity, a, b) == pytest.approx(want)


def test_texts(of):
    assert of(T.romanize, "한국") == "hanguk"
    assert of(T.collapse, "  a \n b ") == "a b"
    assert of(T.collapse, "  ") is None
    assert of(T.clean_missing, " - ") is None
    assert of(T.host, "https://user@News.Example.co.kr:8080/a?b") == "news.example.co.kr"
    assert of(lambda c: T.registrable_domain(T.host(c)), "https://a.news.example.co.kr/x") == "example.co.kr"
    assert of(lambda c: T.registrable_domain(T.host(c)), "https://a.b.example.com/") == "example.com"
    assert of(T.strip_markup, "<p>a &amp; b</p><script>x<y</script><div> c  d</div>") == "a & b\nc d"
    assert of(T.repair_xml, "<?xml version='1.0'?><a>R&D &amp; 3 < 5\x01</a>") == "<a>R&amp;D &amp; 3 &lt; 5</a>"
    assert of(T.title_hash, "[단독] 공장 화재, 생산 중단 (종합)") == of(T.title_hash, "공장 화재 생산중단")
    assert of(T.topics, "대규모 수주 뒤 화재") == ["supply", "incident"]
    assert of(T.final_letter, "서울") is True
    assert of(T.final_letter, "나무") is False
    assert of(T.final_letter, "abc") is None
    assert of(lambda a, b: T.jaccard(T.word_trigrams(a), T.word_trigrams(b)), "word", "word") == 1.0
    assert of(lambda c: T.word_trigrams(c), "cat") == ["  c", " ca", "cat", "at "]


def test_values(of):
    assert of(V.dotted_date, "1977.01.01") == "1977-01-01"
    assert of(V.dotted_date, "1977-01-01") is None
    assert of(V.korean_date, "2028년 3월 18일") == "2028-03-18"
    assert of(V.korean_date, "1960년 12월") == "1960-12"
    assert of(V.korean_date, "-") is None
    assert of(V.compact_date, "20280318") == "2028-03-18"
    assert of(V.compact_date, "0") is None
    assert of(V.tenure_months, "37개월") == 37
    assert of(V.number, "1,234.5") == 1234.5
    assert of(V.number, "-") is None
    assert of(V.months_apart, "2024-03", "2023-01-09") == 14
    assert of(V.months_apart, None, "2023-01-09") == 99
    assert of(V.ratio, 10.0, 4.0, kind="double") == 2.5
    assert of(V.ratio, 10.0, 0.0, kind="double") is None
    assert of(V.cosine, [1.0, 0.0], [1.0, 1.0], kind="array<double>") == pytest.approx(0.5**0.5)
    assert of(V.cosine, [0.0, 0.0], [1.0, 1.0], kind="array<double>") == 0.0
    assert of(V.distance_to_similarity, 0.0, kind="double") == 1.0
    assert of(V.ordered_union, ["b", "a", None], ["a", "c"], kind="array<string>") == ["b", "a", "c"]
    assert of(lambda a, b: V.stable_id("ev_", 16, a, b), "x", None) == of(lambda a, b: V.stable_id("ev_", 16, a, b), "x", "")
