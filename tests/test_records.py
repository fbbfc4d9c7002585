"""Operators on records that their queries do not exercise to the full, and closures over whole tables by brute force."""

from __future__ import annotations

import itertools

import pytest

from lodegraph.functions import text as T
from lodegraph.operators import answers, articles, audits, people, reports
from lodegraph.plans import catalogue, rank_queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def closure(nodes, links):
    """Least reachable node of each."""
    of = {n: {n} for n in nodes}
    for a, b in links:
        if of[a] is not of[b]:
            both = of[a] | of[b]
            for x in both:
                of[x] = both
    return {n: min(g) for n, g in of.items()}


def test_components_over_all_lines(spark):
    rows = {(r.l_suppkey, r.l_partkey // 3) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}
    blocks = {}
    for s, g in rows:
        blocks.setdefault(g, []).append(s)
    links = [(b[0], x) for b in blocks.values() for x in b]
    want = closure({s for s, _ in rows if len(blocks) and any(len(b) > 1 and s in b for b in blocks.values())}, [(a, b) for a, b in links if a != b])
    got = {r.node: r.component for r in catalogue.queries()["er_components"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize(("syllable", "latin"), list(zip("가각갂갃간갅갆갇갈갉갊갋갌갍갎갏감갑값갓갔강갖갗갘같갚갛", [f"ga{x}" for x in ("", "k", "k", "k", "n", "n", "n", "t", "l", "l", "l", "l", "l", "l", "l", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")], strict=True)))
def test_every_final_letter(one_row, syllable, latin):
    assert one_row.select(T.romanize(F.lit(syllable)).alias("x")).first().x == latin


@pytest.fixture(scope="module")
def one_row(spark):
    return spark.range(1)


def test_each_edge_check_finds_its_row(spark):
    good = {"edge_id": "e", "src": "a", "tgt": "b", "type": "SUPPLIES_TO", "subtype": "부품", "source_type": "dart", "confidence": 0.5, "is_current": True, "first_seen": "2020-01-01", "valid_until": "2021-01-01", "last_seen": "2020-06-01", "source_doc": "d", "stage1": None, "suspect": False}
    bad = {
        "edge_meta_missing": {"confidence": None}, "edge_confidence_range": {"confidence": 1.5}, "edge_validity_inverted": {"valid_until": "2019-01-01"}, "edge_seen_in_future": {"last_seen": "2030-01-01"}, "edge_self_loop": {"tgt": "a"},
        "edge_subtype_blank": {"subtype": " · ".strip()}, "edge_supply_is_ownership": {"subtype": "유상증자 참여"}, "edge_partner_is_supply": {"type": "PARTNERS_WITH", "subtype": "납품"}, "edge_source_missing": {"source_doc": None}, "edge_last_seen_missing": {"last_seen": None},
        "edge_stage1_stale": {"stage1": "insufficient"}, "edge_type_unknown": {"type": "KNOWS"}, "edge_source_type_unknown": {"source_type": "blog"}, "edge_suspect_unexplained": {"suspect": True},
    }
    schema = "edge_id string, src string, tgt string, type string, subtype string, source_type string, confidence double, is_current boolean, first_seen string, valid_until string, last_seen string, source_doc string, stage1 string, suspect boolean"
    rows = [good, {**good, "type": "DEVELOPS", "subtype": ""}, {**good, "type": "ACQUIRES", "subtype": "합병"}]
    count = lambda rs: {r.check_id: r.violations for r in audits.count_checks(spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in rs], schema), audits.edge_checks("2024-01-01")).collect()}
    assert set(count(rows).values()) == {0}
    assert set(bad) == set(audits.edge_checks("2024-01-01"))
    for name, change in bad.items():
        assert count([*rows, {**good, **change}])[name] == 1, name


def test_each_node_check_finds_its_row(spark):
    bad = {"node_name_missing": ("Company", " "), "node_name_masked": ("Company", "A사 등"), "node_name_short": ("Company", "12"), "node_name_initial": ("Company", "AB사"), "node_name_sentence": ("Company", "주요 매출처"), "node_label_unknown": ("Firm", "Acme"), "company_named_as_group": ("Company", "금속 노동조합"), "person_named_as_company": ("Person", "주식회사 가나"), "company_sector_missing": ("Company", "Acme")}
    assert set(bad) == set(audits.node_checks())
    for name, (label, text) in bad.items():
        rows = [("k0", "Company", "가나전자", "x"), ("k1", label, text, None if name == "company_sector_missing" else "x")]
        df = spark.createDataFrame(rows, "key string, label string, name string, sector string")
        assert {r.check_id: r.violations for r in audits.count_checks(df, audits.node_checks()).collect()}[name] == 1, name


def test_persons_merge_by_rules(spark):
    persons = [("a", "kim", "1960-01", False), ("b", "kim", None, False), ("c", "kim", "1961-02", False), ("d", "lee", None, True), ("e", "lee", "1970-03", True), ("f", "lee", None, False), ("g", "park", None, False), ("h", "park", None, False), ("i", "choi", "1950-01", False), ("j", "choi", "1951-01", False)]
    posts = [("a", "X"), ("b", "X"), ("c", "Y"), ("f", "Z"), ("g", "U"), ("h", "V"), ("i", "W"), ("j", "W")]
    rosters = [("U", "m1"), ("U", "m2"), ("V", "m1"), ("V", "m2"), ("Z", "m1")]
    got = people.merge_persons(spark.createDataFrame(persons, "key string, name string, birth string, self_owner boolean"), spark.createDataFrame(posts, "key string, company string"), spark.createDataFrame(rosters, "company string, member string"), rank_queries.shared_checkpoint(spark))
    # one firm; both owners; two firms with two members in common; never two births
    assert {(r.key, r.keep) for r in got.collect()} == {("b", "a"), ("d", "e"), ("h", "g")}


def test_sections_of_a_report(spark):
    xml = "<D><S><TITLE>II. 주요 제품 및 서비스</TITLE><P>반도체 &amp; 부품</P></S><S><TITLE>1. [계열회사]</TITLE><P>갑</P></S><S><TITLE>1. 계열회사</TITLE><P>을</P></S><S><TITLE> </TITLE>x</S></D>"
    found = reports.sections(spark.createDataFrame([("r1", xml), ("r2", None)], "rcept_no string, xml string"))
    assert {(r.title, r.body) for r in found.collect()} == {("주요 제품 및 서비스", "반도체 & 부품"), ("계열회사", "갑")}
    wanted = reports.target_sections(found, {"products": "제품및서비스", "affiliates": "계열회사", "contracts": "주요계약"})
    assert {(r.kind, r.body) for r in wanted.collect()} == {("products", "반도체 & 부품"), ("affiliates", "갑")}


def test_names_and_labels(one_row):
    value = lambda c: one_row.select(c.alias("x")).first().x
    assert value(T.clean_name(F.lit(" 가나  전자(주1)* "))) == "가나 전자"
    assert value(T.clean_name(F.lit("-"))) is None
    assert value(T.clean_lines(F.lit("사장\n\n 대표  이사 "))) == "사장 | 대표 이사"
    assert value(T.clean_lines(F.lit("ㆍ부품ㆍ 장비"), "ㆍ")) == "부품 | 장비"
    assert value(T.without_names(F.lit("삼성전자 공장  화재 (사고)"), ["삼성전자"])) == "공장 화재 (사고)"
    assert value(T.route_key(F.lit(" 납품 하는\t곳 A"))) == "납품하는곳a"


def test_leftovers_titles_and_marks(spark):
    rows = [("u1", True, None, [1, 2]), ("u2", True, "2024", [1]), ("u3", False, None, [1]), ("u4", True, None, [9])]
    df = spark.createDataFrame(rows, "url string, llm_relevant boolean, extracted_at string, matched_corps array<int>")
    names = spark.createDataFrame([(1, "가"), (2, "나")], "code int, name string")
    assert [(r.url, r.names) for r in articles.leftovers(df, names).collect()] == [("u1", ["가", "나"])]
    titled = spark.createDataFrame([("가 상승", ["가"]), ("시황", ["가"])], "title string, names array<string>")
    assert [r.title for r in articles.names_in_title(titled).collect()] == ["가 상승"]
    edges = spark.createDataFrame([("e1", "SUES", "bad", True), ("e2", None, "bad", True), ("e3", None, None, None)], "edge_id string, retyped_from string, stage1 string, suspect boolean")
    assert {(r.edge_id, r.stage1, r.suspect) for r in reports.clear_after_retype(edges).collect()} == {("e1", None, None), ("e2", "bad", True), ("e3", None, None)}
    log, rest = reports.split_rows(edges, F.col("suspect"))
    assert (log.count(), rest.count()) == (2, 1)
    moved, slim = reports.audit_properties(edges, ["stage1", "suspect"])
    assert {(r.edge_id, r.properties) for r in moved.collect()} == {("e1", '{"stage1":"bad","suspect":true}'), ("e2", '{"stage1":"bad","suspect":true}')}
    assert slim.columns == ["edge_id", "retyped_from"]
    listed = reports.head_and_variants(spark.createDataFrame([(["a", "b"],), ([],)], "name array<string>"), "name")
    assert [(r.name, r.name_variants) for r in listed.collect()] == [("a", ["a", "b"]), (None, [])]


def test_stale_cards(spark):
    stored, firms = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, digest string"), spark.createDataFrame([("a",)], "key string")
    assert [r.key for r in answers.stale_cards(stored, firms).collect()] == ["b"]


def test_trigram_matches_against_all_pairs(spark):
    from lodegraph.operators import retrieval

    names = [r.name for r in spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_name AS name").distinct().collect()]
    asked = [n[:2] + n[3:] for n in names[:20]] + ["", "zzz"]
    grams = lambda s: {f"  {w} "[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}
    for t in (0.3, 0.5, 0.9):
        got = retrieval.trigram_matches(spark.createDataFrame([(x,) for x in asked], "candidate string"), spark.createDataFrame([(x,) for x in names], "name string"), threshold=t)
        want = {(a, b) for a, b in itertools.product(asked, names) if grams(a) and len(grams(a) & grams(b)) >= t * len(grams(a) | grams(b))}
        assert {(r.candidate, r.name) for r in got.collect()} == want


def test_type_verdicts_move_no_id_made_of_the_ends(spark):
    from lodegraph.operators import reports

    nodes = spark.createDataFrame([("C1", "Company"), ("P1", "Product"), ("N1", "Organization")], "key string, label string")
    rows = [("C1", "P1", "DEVELOPS", "DEPENDS_ON"), ("P1", "C1", "PARTNERS_WITH", "DEPENDS_ON"), ("C1", "P1", "DEVELOPS", "UNKNOWN"), ("C1", "zz", None, None)]
    edges = spark.createDataFrame(rows, "src string, tgt string, type string, asked string").withColumn("edge_id", F.concat("src", "tgt"))
    with_id = sorted(map(tuple, reports.type_verdicts(edges, nodes).collect()))
    assert with_id == sorted(map(tuple, reports.type_verdicts(edges.drop("edge_id"), nodes, F.concat("src", "tgt")).collect()))
    assert {("C1P1", "keep"), ("C1zz", "keep"), ("C1P1", "forward"), ("P1C1", "judge")} == set(with_id)
