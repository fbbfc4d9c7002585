"""Titles from evidence: single sentences, and generated ones against a search one by one."""

from __future__ import annotations

import re

import pytest

from lodegraph.operators import titles
from lodegraph.plans import catalogue, title_queries

POSTS = "edge_id string, person string, company string, subtype string, evidence_ids array<string>"
FIRMS = ["SK스퀘어", "SK하이닉스", "두산로보틱스", "엔비디아", "토스증권", "주식회사 한빛", "A", None]


def norm(s):
    return re.sub(r"[\s()（）㈜(주)]|주식회사", "", s or "").lower()


def one(name, text, company, others):
    own = norm(company)
    for m in re.finditer(rf"{re.escape(name)}\s*([^.。\n]{{0,20}}?)({'|'.join(titles.TITLES)})", text):
        gap = norm(m[1])
        if re.search(titles.FORMER, m[1]):
            continue
        if any(o and len(o) >= 2 and len(norm(o)) >= 2 and norm(o) in gap and (not own or norm(o) != own) for o in others) and (not own or own not in gap):
            continue
        return titles.SHOWN.get(m[2], m[2])
    if len(name) >= 2 and name in text and (not own or own in norm(text)):
        m = re.search(rf"(?<![가-힣]){re.escape(name[0])}\s({'|'.join(titles.TITLES)})", text)
        if m:
            return titles.SHOWN.get(m[1], m[1])
    return None


def brute(posts, evidence, firms):
    texts, out = dict(evidence), set()
    for edge, person, company, subtype, ids in posts:
        if (subtype or "") not in titles.VAGUE or not person:
            continue
        for i in ids or []:
            got = one(person, texts[i], company, firms) if texts.get(i) else None
            if got:
                out.add((edge, got, i))
                break
    return out


def run(spark, posts, evidence, firms):
    df = titles.titles_from_evidence(spark.createDataFrame(posts, POSTS), spark.createDataFrame(evidence, "evidence_id string, text string"), spark.createDataFrame([(f,) for f in firms], "name string"))
    return [tuple(r) for r in df.collect()]


CASES = [
    ("박성하", "SK하이닉스", "박성하 SK스퀘어 사장을 신규선임하는 안건", None), ("박성하", "SK스퀘어", "박성하 SK스퀘어 사장을 신규선임하는 안건", "사장"), ("박성하", "SK하이닉스", "박성하 SK스퀘어 사장, 박성하 기타비상무이사 선임", "기타비상무이사"),
    ("오창훈", "한미", "오창훈 전 토스증권 최고기술책임자를 전무로 영입", None), ("오창훈", "한미", "오창훈 전 CTO가 왔다. 오창훈 전무는 말했다", "전무"), ("김민표", "두산로보틱스", "매디슨 황 엔비디아 수석 이사가 두산로보틱스 김민표 대표이사를 만났다", "대표이사"),
    ("김민표", "두산로보틱스", "김민표를 두산로보틱스가 뽑았다. 김 부사장은 말했다", "부사장"), ("김민표", "두산로보틱스", "김민표가 왔다. 김 부사장은 말했다", None), ("김민표", None, "김민표가 왔다. 김 설립자는 말했다", "창업자"), ("이순", "한빛", "이순 부회장", "부회장"), ("이순", "한빛", "이순 (주식회사 한빛) 상무이사", "상무"),
    ("이.순", "한빛", "이x순 부회장", None), ("이", "한빛", "이 대표", "대표"), ("이순", "한빛", "이순은 한빛에서 일한다 그리고 한참 뒤에야 비로소 나온 회장", None),
]


@pytest.mark.parametrize("k", [0])
def test_cases(spark, k):
    posts = [(f"e{i}", p, c, "임원", [f"v{i}"]) for i, (p, c, _, _) in enumerate(CASES)]
    evidence = [(f"v{i}", t) for i, (_, _, t, _) in enumerate(CASES)]
    got = {e: t for e, t, _ in run(spark, posts, evidence, FIRMS)}
    assert got == {f"e{i}": t for i, (*_, t) in enumerate(CASES) if t}
    assert {(e, t) for e, t, _ in brute(posts, evidence, FIRMS)} == set(got.items())


def test_order_of_evidence_and_odd_rows(spark):
    evidence = [("a", "김민표 전무"), ("b", "김민표 사장"), ("n", None), ("z", "")]
    posts = [("1", "김민표", "x", None, ["n", "z", "b", "a", "b"]), ("2", "김민표", "x", "사장", ["a"]), ("3", None, "x", "", ["a"]), ("4", "김민표", None, "other", None), ("5", "", "x", "", ["a"]), ("6", "김민표", "x", "OTHER", ["gone", None, "a"])]
    assert set(run(spark, posts, evidence, [])) == {("1", "사장", "b"), ("6", "전무", "a")}


def test_query_against_a_search_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    posts = [tuple(r) for r in title_queries.posts(spark, sf).select("edge_id", "person", "company", "subtype", "evidence_ids").collect()]
    evidence = [tuple(r) for r in title_queries.sentences(spark, sf).select("evidence_id", "text").collect()]
    firms = [r.name for r in title_queries.firms(spark, sf).collect()]
    got = [tuple(r) for r in catalogue.queries()["executive_titles"](spark, sf).collect()]
    want = brute(posts, evidence, firms)
    assert len(got) == len(set(got)) and set(got) == want and len({t for _, t, _ in want}) > 5
