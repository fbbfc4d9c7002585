"""Dictionary names in texts against a search for each name in each text; fixed lists against words written out here."""

from __future__ import annotations

import random

import pytest

from lodegraph.operators import articles, dictionary, repairs


def world(seed):
    rng = random.Random(seed)
    letters = "가나다라마ab "
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))).strip() for _ in range(60)}
    names = [(f"c{i % 50}", n) for i, n in enumerate(sorted(n for n in names if len(n) >= 2))] + [("x", "가"), ("y", ""), (None, "나다"), ("z", None), ("dup", "가나"), ("dup2", "가나")]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 80, 400])))) for i in range(25)] + [(90, None), (91, ""), (92, "가나"), (93, "가나" * 900), (94, "👋가나👋 b")]
    return texts, names


def found(texts, names):
    out = set()
    for ident, text in texts:
        for code, name in names:
            if text and name and len(name) >= 2 and code is not None:
                out |= {(ident, i + 1, len(name), code, name) for i in range(len(text)) if text.startswith(name, i)}
    return out


def frames(spark, texts, names):
    return spark.createDataFrame(texts, "ident int, text string"), spark.createDataFrame(names, "code string, name string")


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_every_place_of_every_name(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dictionary, "MOST_BROADCAST", broadcast)
    texts, names = world(1)
    got = [tuple(r)[:5] for r in dictionary.occurrences(*frames(spark, texts, names)).collect()]
    assert len(got) == len(set(got)) and set(got) == found(texts, names)


def test_longest_from_left_to_right(spark):
    texts, names = world(2)
    want = set()
    for ident, text in texts:
        at, places = 1, {}
        for _, start, n, code, name in sorted(x for x in found([(ident, text)], names)):
            places[start] = min(places.get(start, (0, "~", "")), (-n, code, name))
        for start in sorted(places):
            n, code, name = places[start]
            if start >= at:
                want.add((ident, start, -n, code, name))
                at = start - n
    assert {tuple(r) for r in dictionary.longest(dictionary.occurrences(*frames(spark, texts, names))).collect()} == want


def test_whole_words_and_particles(spark):
    texts = ["삼성전자", "삼성전자가 왔다", "(삼성전자)는", "삼성전자서비스", "옛삼성전자", "그 삼성전자에서는", "삼성전자, 곧", "삼성전자으로부터", "x삼성전자", "삼성전자에서는요"]
    t, n = frames(spark, list(enumerate(texts)), [("a", "삼성전자")])
    assert {r.ident for r in dictionary.whole_words(dictionary.occurrences(t, n)).collect()} == {0, 1, 2, 5, 6, 7}


def test_no_names_or_texts(spark):
    texts, names = world(3)
    for t, n in (([], names), (texts, []), (texts, [("x", "가")])):
        assert dictionary.longest(dictionary.occurrences(*frames(spark, t, n))).count() == 0


def test_gate_reads_every_relation_word(spark):
    # fixed values, written out again
    words = "인수 합병 피인수 매각 양수 양도 인수합병 M&A 지분 출자 투자 지주 계열 자회사 최대주주 주주 공급 납품 수주 계약 체결 발주 조달 위탁 외주 거래 구매 판매 공급망 밸류체인 협력사 파트너사 제휴 협력 협약 MOU 합작 JV 공동개발 공동 기술이전 라이선스 동맹 파트너십 손잡 맞손 입점 진출 협업 소송 제소 피소 고소 분쟁 특허침해 침해 갈등 규제 제재 과징금 조사 시정명령 위반 담합 공정위 경쟁 점유율 1위 추격 맞대결 격차 리콜 결함 화재 사고 중단 차질 부도 회생 구조조정".split()
    rows = [(f"{i}", f"에스케이 공장 {w}", None) for i, w in enumerate(words)] + [("none", "에스케이 공장 소식", ""), ("firm", "공장 화재", "x"), ("body", "소식", "에스케이 화재"), ("null", None, None), ("body", "소식", "에스케이 소식")]
    a = spark.createDataFrame(rows, "ident string, title string, body string")
    got = [(r.ident, r.passed, r.why, r.codes) for r in articles.rule_gate(a, spark.createDataFrame([(1, "에스케이"), (2, "스케"), (3, "없음")], "code int, name string").selectExpr("string(code) AS code", "name")).collect()]
    assert sorted(g[0] for g in got if g[1]) == sorted([str(i) for i in range(len(words))] + ["body"])
    assert {g[0]: g[2] for g in got if not g[1]} == {"none": "no_word", "firm": "no_firm", "null": "no_firm", "body": "no_word"}
    assert {tuple(g[3]) for g in got if g[2] != "no_firm"} == {("1", "2")}


def test_unit_endings(spark):
    # fixed values, written out again
    endings = "사업부 사업본부 사업부문 부문 본부 공장 제조시설 생산기술원 기술원 연구소 연구원 사업소 캠퍼스 랩 센터".split()
    names = [(f"k{i}", f"한빛전자 평택{e}") for i, e in enumerate(endings)] + [("no1", "한빛전자 지점"), ("no2", "한빛전자 미국지사")]
    got = repairs.units_of_parents(spark.createDataFrame(names, "key string, name string"), spark.createDataFrame([("p", "한빛전자")], "key string, name string"))
    assert {r.key for r in got.collect()} == {f"k{i}" for i in range(len(endings))}


def test_names_that_share_all_their_grams(spark):
    # numbered names: every trigram is in many of them
    names = [(str(i), f"Customer#{i:06d}") for i in range(4000)] + [("p", "Customer#00000")]
    texts = [(i, f"1-URGENT Customer#{i * 7 % 5000:06d}는 x Customer#{i:06d}") for i in range(300)]
    t, n = frames(spark, texts, names)
    # a place meets one word per length, not one per name of its rarest gram
    assert dictionary.words(t, dictionary.named(n)).count() == 2 * 2 * 300
    assert {tuple(r)[:5] for r in dictionary.occurrences(t, n).collect()} == found(texts, names)
