from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import vocabulary as V
from lodegraph.operators import filings, repairs


def one(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_subtypes_have_fixed_points(spark):
    rows = [(k, f) for k, forms in V.SUBTYPES.items() for f in forms]
    got = spark.createDataFrame(rows, "k string, f string").withColumn("c", V.canonical_subtype(F.col("k"), F.col("f"))).where("c <> f").count()
    assert got == 0
    rows = [("SUES", "Patent infringement"), ("SUES", " OTHER "), ("SUES", None), ("SUPPLIES_TO", "wafer"), ("ACQUIRES", "-합병.")]
    got = spark.createDataFrame(rows, "k string, f string").select(V.canonical_subtype(F.col("k"), F.col("f")).alias("c"))
    assert [r.c for r in got.collect()] == ["특허침해", "", "", "wafer", "합병"]


def test_untyped_relations_and_lawsuits(spark):
    rows = [("지분 20% 취득", "납품 계약"), (None, "양해 각서"), ("협력 기대", None), ("", "특허 4개를 침해")]
    got = [r.t and tuple(r.t) for r in spark.createDataFrame(rows, "a string, b string").select(V.type_of_expression(F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == [("OWNS_STAKE_IN", "지분투자"), ("PARTNERS_WITH", "업무협약"), None, ("SUES", "특허침해")]
    rows = [("미국 무역위원회", "소송"), ("A사", "사과 요구"), ("A사", "소송"), (None, None)]
    got = [r.t for r in spark.createDataFrame(rows, "a string, b string").select(V.lawsuit_or(F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == ["REGULATES", "DROP", "SUES", "SUES"]


def test_event_names(spark):
    rows = [("HBM4용 본더 공급 계약", "HBM4"), ("Cosmos Cookoff 1위", "코스모스 쿡오프 1위"), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string").select(V.event_word(F.col("a")).alias("w"), V.event_roots(F.col("a")).alias("r"), V.same_recurring_event(F.col("a"), F.col("b")).alias("s"))
    got = df.collect()
    assert [r.w for r in got] == ["공급계약", None, None]
    assert got[0].r == ["HBM4", "본더", "공급", "계약"] and got[1].r == ["코스모스", "코스모", "쿡오프"] and got[2].r == []
    assert [r.s for r in got] == [True, True, False]


def test_holders(spark):
    schema = "corp string, name string, relation string, stock string, percent double, percent_before double, shares long, shares_before long, doc string, day string, place int"
    rows = [
        ("1", "김 하나", "본인", "우선주", 9.0, 9.0, 90, 90, "d", "2024", 1), ("1", "김  하나", "본인", "보통주", 7.5, 7.0, 75, 70, "d", "2024", 2),
        ("1", "이둘", "친인척", "보통주", 0.4, None, 4, None, "d", "2024", 3), ("1", "박셋", "최대주주의 자", "보통주", 0.2, 0.2, 2, 2, "d", "2024", 4),
        ("1", "한빛 주식회사", "계열회사", "보통주", 0.1, 0.1, 1, 1, "d", "2024", 5), ("1", "합계", None, "보통주", 99.0, 99.0, 9, 9, "d", "2024", 6), ("1", None, None, None, None, None, None, None, None, None, 7),
    ]
    got = filings.holder_edges(spark.createDataFrame(rows, schema))
    assert one(got, "src", "subtype", "percent", "shares_change", "changed", "others") == [
        ("김 하나@1", "최대주주", 7.5, 5, True, "우선주 9.0%"), ("박셋@1", "특수관계인", 0.2, 0, False, ""), ("한빛", "특수관계인", 0.1, 0, False, ""),
    ]


def test_executives(spark):
    schema = "corp string, name string, registered string, position string, birth string, tenure string, career string, doc string, day string"
    rows = [
        ("1", "김하나", "사내이사", "대표 이사", "1960년 12월", "5개월", "(현)한빛 대표\n (전)새별 이사ㆍ학회 회장", "d", "2024"), ("1", "이둘", "사외이사", "이사", None, "24개월", "-", "d", "2024"),
        ("1", "박셋", "미등기", "상무", None, None, None, "d", "2024"), ("1", "최넷", "미등기", "부회장", None, None, None, "d", "2024"), ("1", None, "사내이사", "이사", None, None, None, "d", "2024"),
    ]
    got = filings.executive_edges(spark.createDataFrame(rows, schema))
    assert sorted(map(str, one(got, "src", "subtype", "is_new", "career"))) == sorted(map(str, [
        ("김하나|1960-12", "대표이사", True, "(현)한빛 대표 | (전)새별 이사 | 학회 회장"), ("이둘@1", "사외이사", False, None), ("최넷@1", "부회장", None, None),
    ]))


def test_investments_and_bulk_holdings(spark):
    rows = [("1", "새별 Co., Ltd.", 50.0, 40.0, "2020.01.02", "d", "2024"), ("1", "한빛", 50.1, None, "x", "d", "2024"), ("1", "계", 9.0, 9.0, None, "d", "2024")]
    got = filings.investment_edges(spark.createDataFrame(rows, "corp string, name string, percent double, percent_before double, acquired string, doc string, day string"))
    assert one(got, "tgt", "subtype", "increased", "valid_from") == [("새별", "출자", True, "2020-01-02"), ("한빛", "자회사", None, None)]
    rows = [("1", "국민연금", 5.1, "20240101", "a", "d1", 1), ("1", "국민연금", 6.1, "20240301", "b", "d2", 2), ("1", "국민연금", 7.1, "20240301", "c", "d3", 3)]
    got = filings.bulk_edges(spark.createDataFrame(rows, "corp string, name string, percent double, reported string, reason string, doc string, place int"))
    assert one(got, "src", "percent", "valid_from", "doc") == [("국민연금@1", 6.1, "2024-03-01", "d2")]


def test_contracts(spark):
    form = "<p>계약상대방 {} 최근 매출액(원)</p> 계약금액(원) 1,200 매출액대비(%) 12.34 계약기간 시작일 2024-01-01 종료일 2024-12-31 계약(수주)일자 2023-12-30"
    rows = [("1", "d1", "2024-01-01", 1, form.format("SK하이닉스(SK Hynix Inc.)")), ("1", "d2", "2024-02-01", 2, form.format("SK하이닉스")), ("1", "d3", "2024-03-01", 3, form.format("해외 제조사")), ("1", "d4", None, 4, None), ("1", "d5", None, 5, "")]
    df = spark.createDataFrame(rows, "corp string, doc string, reported string, place int, text string")
    got = one(filings.contract_edges(df), "src", "tgt", "amount", "revenue_ratio", "valid_until", "occurred_at", "doc")
    assert got == [("1", "sk하이닉스", 1200, 0.1234, "2024-12-31", "2023-12-30", "d2")]
    assert {r.doc for r in filings.contract_fields(df).where("is_anonymous").collect()} == {"d3"}


def test_key_repairs(spark):
    nodes = spark.createDataFrame([("a/b",), ("ab",), ("c/d",), ("e/f",), ("ef/",), (None,)], "key string")
    assert one(repairs.free_of_slashes(nodes), "old", "keep") == [("c/d", "cd")]
    names = spark.createDataFrame([("1", "한빛전자 반도체사업부"), ("2", "한빛"), ("3", "한빛전자"), ("4", "한빛전자공업")], "key string, name string")
    assert one(repairs.units_of_parents(names, names), "key", "parent", "unit") == [("1", "3", "반도체사업부")]
    c = spark.createDataFrame([("x", "1", False), ("x", "2", False), ("y", "1", True), ("y", "2", False), ("z", "1", False)], "key string, code string, listed boolean")
    assert one(repairs.ambiguous_firms(c), "key") == [("x",)]


def test_retype_and_matrix(spark):
    rules = spark.createDataFrame([(x, a, b) for x, _, a, b in S.EDGE_RULES], "edge string, a string, b string")
    rows = [("1", "SUPPLIES_TO", "Company", "Company", "SUPPLIES_TO 방향"), ("2", "SUPPLIES_TO", "Company", "Company", "SUPPLIES_TO"), ("3", "SUPPLIES_TO", "Company", "Company", "ACQUIRES"), ("4", "DEVELOPS", "Company", "Product", "REGULATES"), ("5", "DEPENDS_ON", "Company", "Organization", "REGULATES"), ("6", "SUES", "Person", "Company", None)]
    got = repairs.retype_action(spark.createDataFrame(rows, "edge_id string, type string, src_label string, tgt_label string, hint string"), rules)
    assert one(got, "edge_id", "action", "new_type") == [("1", "invert", "SUPPLIES_TO"), ("2", "hold", "SUPPLIES_TO"), ("3", "retype", "ACQUIRES"), ("4", "reject", "DEVELOPS"), ("5", "flip", "REGULATES"), ("6", "reject", "SUES")]
    pairs = spark.createDataFrame([("REGULATES", "Organization", "Company"), ("REGULATES", "Company", "Organization"), ("PARTNERS_WITH", "Company", "Organization")], "e string, a string, b string")
    assert [r.ok for r in pairs.select(repairs.legal(F.col("e"), F.col("a"), F.col("b")).alias("ok")).collect()] == [True, False, True]


def test_split_and_convergence(spark):
    v = spark.createDataFrame([("E", "a", "1"), ("E", "a", "2"), ("E", "b", "2"), ("E", "b", "3"), ("F", "a", "1")], "event_id string, label string, doc string")
    edges = spark.createDataFrame([("E", "1", "x"), ("E", "3", "y"), ("F", "1", "z")], "event_id string, doc string, tgt string")
    keys, moved = repairs.split_events(v, edges)
    assert one(keys, "event_id", "label", "docs")[0] == ("E", "a", ["1", "2"]) and keys.count() == 2
    new = {r.label: r.new_id for r in keys.collect()}
    assert new["a"] == "E" and new["b"].startswith("evt_split_")
    assert one(moved, "tgt", "event_id") == [("x", "E"), ("y", new["b"]), ("z", "F")]
    c = spark.createDataFrame([("T", "공급 계약", 9), ("T", "공급계약", 2), ("T", "수주", 1), ("U", "공급-계약", 1)], "type string, subtype string, n long")
    assert one(repairs.convergent_subtypes(c, F.lit(False)), "subtype", "keep") == [("공급계약", "공급 계약")]
    assert one(repairs.convergent_subtypes(c, F.col("subtype") == "공급계약"), "subtype", "keep") == [("공급 계약", "공급계약")]


def test_form_fields_are_found_once(spark):
    df = spark.createDataFrame([("1", "d", "2024", 1, "계약상대방 한빛(주) 최근 매출액")], "corp string, doc string, reported string, place int, text string")
    plan = filings.contract_edges(df)._jdf.queryExecution().optimizedPlan().toString()
    # two for the text, one for what stands before the sales
    assert plan.count("<[^>]+>") == 1 and plan.count("계약상대방") == 1
    assert [tuple(r)[:2] for r in filings.contract_edges(df).collect()] == [("1", "한빛")]
