"""Rule audits: named checks that should find nothing. All checks of one table are one pass over it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


#: Patterns of names and subtypes that the checks look for.
MASKED = r"^[A-Za-z가-힣]사(\s*(外|외|등))?$"
INITIAL = r"^([A-Za-z]{1,2}|[가-힣])사$"
SENTENCE = "매출|기재|요청|영업비밀|중에서|선주|제조사|대형기업|공시유보"
GROUP_NAME = "조합원|노동조합|노조|위원회|협회|연맹"
FIRM_NAME = r"㈜|\(주\)|주식회사|유한회사|(?i)[ ,]\s*(inc|ltd|llc|corp|gmbh|plc|limited)\.?$"
OWNERSHIP_WORDS = "매각|전환사채|유상증자|신주|대여|차입|합병|청산|출자"
SUPPLY_WORDS = "공급계약|납품|OEM|ODM"
#: Edge types that have no subtype of their own.
WITHOUT_SUBTYPE = ("DEVELOPS", "HAS_EVENT", "IMPACTS")


def count_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_id, violations): each check is a condition; one scan and one aggregate serve them all."""
    counts = [F.struct(F.lit(name).alias("check_id"), F.count_if(F.coalesce(rule, F.lit(False))).alias("violations")) for name, rule in checks.items()]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def node_checks() -> dict[str, Column]:
    name = F.col("name")
    return {
        "node_name_missing": name.isNull() | (F.trim(name) == ""),
        "node_name_masked": name.rlike(MASKED),
        "node_name_short": (F.length(F.trim(name)) <= 1) | ~name.rlike(r"\p{L}"),
        "node_name_initial": name.rlike(INITIAL),
        "node_name_sentence": name.rlike(SENTENCE),
        "node_label_unknown": ~F.col("label").isin(*S.NODE_TYPES),
        "company_named_as_group": (F.col("label") == "Company") & name.rlike(GROUP_NAME),
        "person_named_as_company": (F.col("label") == "Person") & name.rlike(FIRM_NAME),
        "company_sector_missing": (F.col("label") == "Company") & F.col("sector").isNull(),
    }


def edge_checks(today: str) -> dict[str, Column]:
    c = F.col
    return {
        "edge_meta_missing": c("source_type").isNull() | c("confidence").isNull() | c("is_current").isNull(),
        "edge_confidence_range": (c("confidence") < 0) | (c("confidence") > 1),
        "edge_validity_inverted": c("valid_until") < c("first_seen"),
        "edge_seen_in_future": c("last_seen") > today,
        "edge_self_loop": c("src") == c("tgt"),
        "edge_subtype_blank": ~c("type").isin(*WITHOUT_SUBTYPE) & (c("subtype").isNull() | F.trim("subtype").isin("", ".", "·", "-")),
        "edge_supply_is_ownership": (c("type") == "SUPPLIES_TO") & c("subtype").rlike(OWNERSHIP_WORDS),
        "edge_partner_is_supply": (c("type") == "PARTNERS_WITH") & c("subtype").rlike(SUPPLY_WORDS),
        "edge_source_missing": c("source_doc").isNull(),
        "edge_last_seen_missing": c("last_seen").isNull(),
        "edge_stage1_stale": c("stage1").isNotNull() & (c("stage1") != "wrong_type") & ~F.coalesce("suspect", F.lit(False)),
        "edge_type_unknown": ~c("type").isin(*[e for e, *_ in S.EDGE_MATRIX]),
        "edge_source_type_unknown": ~c("source_type").isin("dart", "dart_filing", "news"),
        "edge_suspect_unexplained": c("suspect") & c("stage1").isNull(),
    }


def matrix_violations(edges: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, tgt, type, why) of edges that the matrix does not allow, symmetric types either way.

    rules has edge, a, b; it is the fixed matrix, so broadcasting it is bounded.
    """
    ends = edges.join(nodes.select(F.col("key").alias("src"), F.col("label").alias("a")), "src", "left").join(nodes.select(F.col("key").alias("tgt"), F.col("label").alias("b")), "tgt", "left")
    r = rules.select(F.col("edge").alias("type"), "a", "b")
    turned = r.where(F.col("type").isin(*S.SYMMETRIC)).select("type", F.col("b").alias("a"), F.col("a").alias("b"))
    ok = F.broadcast(r.unionByName(turned).distinct().withColumn("ok", F.lit(True)))
    j = ends.join(ok, ["type", "a", "b"], "left").where("ok is null")
    why = F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown_node").otherwise("not_allowed")
    return j.select("src", "tgt", "type", why.alias("why"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("tgt").alias("key"))).distinct()
    return nodes.join(ends, "key", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, side, key): ends that no node has."""
    end = lambda c: F.struct(F.lit(c).alias("side"), F.col(c).alias("key"))
    ends = edges.select("edge_id", F.explode(F.array(end("src"), end("tgt"))).alias("e")).select("edge_id", "e.*")
    return ends.join(nodes.select("key"), "key", "left_anti").select("edge_id", "side", "key")
