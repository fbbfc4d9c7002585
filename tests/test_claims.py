"""Claims against evidence: single cases, and joins on hot keys."""

from __future__ import annotations

import pytest

from lodegraph.operators import claims, skew

CLAIMS = "claim_id string, answer_id int, text string, cited array<string>"
EVIDENCE = "evidence_id string, text string, published_at string, missing boolean, event_types array<string>"
CONTEXTS = "answer_id int, targets array<string>, names array<string>, matched array<string>"
SOURCES = [
    ("fire", "청주 공장에서 화재가 나 라인이 멈췄다", "2026-06-12", False, ["사고"]),
    ("deal", "에스에프에이반도체는 삼성전자에 장비를 납품한다. 계약일은 2026-03-18이다", None, None, ["기타"]),
    ("tail", "대부분의 투자는 공장 확대에 쓰인다\n\n— 「삼성전자 SK하이닉스 투자」 http://x.y/z", "", False, None),
    ("gone", "사라진 글", None, True, ["파업"]),
    ("blank", "  \n", None, False, []),
    (None, "이름 없는 글", None, False, []),
]
CASES = {
    # id: (text, cited, what is expected)
    "uncited": ("삼성전자가 투자한다", [], {"status": "uncited", "score": None, "claim_type": None, "misattributed": []}),
    "null": (None, None, {"status": "uncited", "score": None, "missing": []}),
    "unknown": ("삼성전자가 투자한다", ["none", "gone", "blank"], {"status": "no_text", "score": None, "intent_linked": False}),
    "particles": ("에스에프에이반도체가 삼성전자에 장비를 납품하였다", ["deal"], {"status": "scored", "score": 1.0, "missing": [], "intent_linked": None}),
    "dates": ("2026년 3월 18일에 계약", ["deal"], {"score": 1.0}),
    "shown_day": ("2026년 6월 12일 화재", ["fire"], {"score": 1.0, "intent_linked": True}),
    "other_day": ("2025년 1월 2일 화재", ["fire"], {"missing": ["2025-01-02"], "score": 0.5}),
    "pooled": ("화재와 납품", ["fire", "deal"], {"score": 1.0}),
    "wrong": ("HBM3E 양산", ["fire"], {"score": 0.0, "missing": ["HBM3E", "양산"]}),
    "free": ("이 사고로 인해 생산에 영향을 미쳤을 가능성이 있습니다", ["fire"], {"claim_type": "free_combination"}),
    "free_uncited": ("이 사고로 인해 생산이 줄었다", [], {"claim_type": "free_combination", "effect_score": None}),
    "stated": ("화재로 인해 라인이 멈췄다", ["fire"], {"claim_type": None, "effect_score": 1.0}),
    "aimed": ("화재로 인해 한미반도체 생산이 줄었다", ["fire"], {"claim_type": "propagation", "effect_score": None}),
    "empty_effect": ("규제 때문에 ", ["fire"], {"claim_type": None, "effect_score": None}),
    "headline": ("삼성전자와 네이버가 투자한다", ["tail"], {"title_only": ["삼성전자"], "misattributed": ["네이버"]}),
    "body": ("삼성전자가 장비를 받는다", ["tail", "deal"], {"title_only": [], "misattributed": []}),
    "clause": ("계약일", ["fire", "deal"], {"best_evidence": "deal", "best_clause": "계약일은 2026-03-18이다", "best_share": 1.0}),
}


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(k, 1, text, cited) for k, (text, cited, _) in CASES.items()] + [("other", 2, "삼성전자 투자", ["deal"]), ("nowhere", None, "삼성전자 투자", ["fire", None, "fire"])]
    contexts = [(1, ["한미반도체", ""], ["삼성전자", "네이버", "", "SK하이닉스"], ["사고"]), (2, None, None, None)]
    df = claims.check(spark.createDataFrame(rows, CLAIMS), spark.createDataFrame(SOURCES, EVIDENCE), spark.createDataFrame(contexts, CONTEXTS))
    return {r["claim_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("case", CASES)
def test_case(checked, case):
    assert {k: checked[case][k] for k in CASES[case][2]} == CASES[case][2]


def test_every_claim_has_a_row(checked):
    assert set(checked) == {*CASES, "other", "nowhere"}
    assert checked["other"]["intent_linked"] is None and checked["other"]["misattributed"] == []


def test_summary_of_nothing(spark):
    none = claims.check(spark.createDataFrame([], CLAIMS), spark.createDataFrame([], EVIDENCE), spark.createDataFrame([], CONTEXTS))
    assert claims.summary(none).first()["claims"] == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_as_others(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "LEAST", 5)
    left = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(80)] + [(None, 99)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 61, 65, 1000)] + [(None, "null")], "k int, r string")
    got = skew.skew_join(left, right, "k", how)
    assert sorted(got.collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)
    assert "BroadcastExchange" in got._jdf.queryExecution().toString()
