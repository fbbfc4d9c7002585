"""Material for answers: contradictions between events and their evidence, order and slots of relations, cards, search, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Words of risk in the names of events.
RISK_LABELS = (
    "소송", "피소", "제소", "패소", "패배", "파기환송", "항소", "판결", "공판", "가처분", "분쟁", "다툼", "담합", "혐의", "기소", "검찰", "수사", "압수수색", "세무조사", "과징금", "과태료", "제재", "시정명령", "위반", "위법", "불법", "적발", "고발", "배임", "횡령", "은폐", "편법", "부당", "침해", "탈취", "시세조종", "부당이득", "몰아주기", "위장계열사", "허위공시", "불공정거래",
    "자본시장법", "특수상해", "성희롱", "갑질", "강요", "방해", "저지", "제한", "금지", "취소", "처분", "청구", "손배", "구제신청", "내부고발", "투서", "자작극", "투자사기", "선행매매", "불완전판매", "불성실공시법인", "상장폐지", "상장적격성", "거래정지", "투자경고종목", "투자위험종목", "직무집행정지가처분", "주주대표소송", "집단소송", "근로자지위확인",
    "사고", "재해", "중대재해", "산업재해", "화재", "폭발", "누출", "유출", "붕괴", "추락", "끼임사고", "사망사고", "공정사고", "폭발사고", "참사", "부상", "피해", "피폭", "노출", "유독가스", "방사선", "손상", "파손", "감염", "좌초", "봉쇄", "차단", "셧다운",
    "파업", "총파업", "부분파업", "쟁의", "농성", "집회", "결의대회", "투쟁", "갈등", "교착", "결렬", "난항", "반발", "부결", "해고", "부당해고", "희망퇴직", "노동쟁의", "불법파견", "미가입자", "퇴직금소송", "임금소송",
    "적자", "적자전환", "영업적자", "영업손실", "순손실", "손실", "쇼크", "어닝쇼크", "급감", "감소", "하락", "부진", "환손실", "위기", "리스크", "사법리스크", "미납", "청산", "기업회생", "감사의견", "축소", "동결",
    "차질", "중단", "지연", "감산", "대란", "결함", "불량", "오류", "에러", "리콜", "오작동", "무산", "보류", "철회", "연기", "탈락", "거부", "거절", "해지", "제외", "역효과", "논란", "의혹", "문제", "비판", "논쟁", "사태", "해킹", "랜섬웨어", "군사기밀", "기술탈취", "핵심기술",
)
#: What says the opposite of a word of risk.
OPPOSITES = {
    "차질": ("정상", "순항", "본격", "시작", "돌입", "확대", "개선", "호조"),
    "중단": ("재개", "가동", "정상화", "본격", "시작", "착수", "확대"),
    "지연": ("앞당", "조기", "예정대로", "완공", "준공", "개시"),
    "감산": ("증산", "확대", "증설", "본격"),
    "적자": ("흑자", "영업이익", "순이익", "개선", "성장", "호실적"),
    "적자전환": ("흑자전환", "흑자", "개선"),
    "영업손실": ("영업이익", "흑자", "개선"),
    "영업적자": ("영업이익", "흑자", "개선"),
    "순손실": ("순이익", "흑자"),
    "손실": ("이익", "흑자", "수익"),
    "급감": ("급증", "증가", "성장", "확대", "호조"),
    "감소": ("증가", "성장", "확대", "늘", "호조"),
    "하락": ("상승", "반등", "급등", "회복"),
    "부진": ("호조", "선전", "회복", "개선", "성장"),
    "패소": ("승소", "인용", "기각"),
    "무산": ("성사", "체결", "확정", "승인"),
    "보류": ("승인", "확정", "재개", "결정"),
    "철회": ("확정", "추진", "강행"),
    "탈락": ("선정", "진입", "확보", "수주"),
    "거부": ("수용", "합의", "승인"),
    "거절": ("수용", "합의", "승인"),
    "결렬": ("타결", "합의", "체결"),
    "난항": ("타결", "순항", "합의"),
    "부결": ("가결", "통과", "승인"),
    "위기": ("호황", "회복", "개선", "성장"),
    "축소": ("확대", "증설", "확장"),
    "리스크": ("안정", "해소"),
}
#: Signs of a background clause.
BACKGROUND = ("와 관련", "과 관련", "년 만에", "지난해", "바 있다", "앞서", "그동안", "이전에", "당시", "한 지")
#: Kinds of relation that a question asks for by its words, and those with a direction.
ASKED = (("SUPPLIES_TO", "납품|공급", "[가이]\\s*(?:납품|공급)", "(?:에|에게)\\s*(?:납품|공급)"), ("OWNS_STAKE_IN", "투자|지분|출자|최대주주", "[가이]\\s*(?:투자|출자)", "(?:에|에게)\\s*(?:투자|출자)"), ("SUES", "소송|제소|피소", "[가이]\\s*제소", "(?:를|을)\\s*제소|피소"))
ASKED_BY_WORD = (("PARTNERS_WITH", "협력"), ("COMPETES_WITH", "경쟁"), ("ACQUIRES", "인수"), ("REGULATES", "규제"), ("DEVELOPS", "개발"), ("DEPENDS_ON", "의존"), ("IS_EXECUTIVE_OF", "임원"), ("HAS_EVENT", "사건"), ("IMPACTS", "영향"))
#: Kinds of insight cards that have slots of their own, and the order of the others.
RISKY, FRESH = ("shared_risk", "cascade_risk"), ("inbound_risk", "event_ongoing", "contract_expiring")


def own_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, blob): the texts of each event's own evidence, in order of ids; events (event_id, evidence_ids) without any text go."""
    pairs = events.select("event_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    texts = pairs.join(evidence.where("not missing and text <> ''"), "evidence_id")
    return texts.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "text"))), lambda x: x["text"]), "\n").alias("blob"))


def _held(words: Sequence[str], c: Column) -> Column:
    """The words that a text holds, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def polarity_flags(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, label_words, evidence_words): risk events whose name's words of risk are absent from their evidence, which holds an opposite."""
    risky = events.where("is_risk").select("event_id", "name", "evidence_ids").withColumn("words", _held(RISK_LABELS, F.col("name"))).where("size(words) > 0")
    j = risky.join(own_evidence(risky, evidence), "event_id")
    absent = F.filter("words", lambda w: ~F.contains(F.col("blob"), w))
    pairs = F.create_map(*[x for w, o in OPPOSITES.items() for x in (F.lit(w), F.array(*map(F.lit, o)))])
    opposite = F.array_sort(F.array_distinct(F.flatten(F.transform("label_words", lambda w: F.filter(F.coalesce(F.element_at(pairs, w), F.array().cast("array<string>")), lambda o: F.contains(F.col("blob"), o))))))
    return j.withColumn("label_words", absent).withColumn("evidence_words", opposite).where("size(evidence_words) > 0").select("event_id", "label_words", "evidence_words")


def temporal_flags(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_id, occurred_year, evidence_years, markers): events whose evidence names years before the year before they occurred."""
    e = events.withColumn("occurred_year", F.substring("occurred_at", 1, 4).try_cast("int")).where("occurred_year is not null")
    j = e.select("event_id", "occurred_year").join(own_evidence(e, evidence), "event_id")
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("blob", F.lit(r"((?:19|20)\d{2})\s*년"), 1), lambda y: y.cast("int"))))
    j = j.withColumn("evidence_years", F.filter(years, lambda y: y < F.col("occurred_year") - 1)).where("size(evidence_years) > 0")
    return j.select("event_id", "occurred_year", "evidence_years", _held(BACKGROUND, F.col("blob")).alias("markers"))


def asked_relations(question: Column) -> tuple[Column, Column]:
    """(types, direction) that a question asks for; the first directed kind decides the direction, if it shows one and not both."""
    deep = [F.when(question.rlike(words), F.lit(kind)) for kind, words, _, _ in ASKED]
    plain = [F.when(F.contains(question, F.lit(word)), F.lit(kind)) for kind, word in ASKED_BY_WORD]
    way = lambda out, into: F.when(question.rlike(out) & ~question.rlike(into), "outgoing").when(question.rlike(into) & ~question.rlike(out), "incoming")
    direction = F.coalesce(*[F.when(question.rlike(words), way(out, into)) for _, words, out, into in ASKED])
    return F.array_compact(F.array(*deep, *plain)), direction


def in_rings(relations: DataFrame, keys: Sequence[str], *, types: Sequence[str] = (), direction: str | None = None, symmetric: Sequence[str] = (), per_company: int = 10) -> DataFrame:
    """relations with ring and pos, at most per_company for each of keys: rings from the inside out, then asked types, then the asked direction, then score.

    Ring 0 has both ends among keys, 1 a company outside, 2 another node outside, 3 neither end. relations has src,
    tgt, src_label, tgt_label, type, score, edge_id.
    """
    a, b = F.col("src").isin(*keys), F.col("tgt").isin(*keys)
    outside = F.when(a, F.col("tgt_label")).otherwise(F.col("src_label"))
    ring = F.when(a & b, 0).when(~a & ~b, 3).when(outside == "Company", 1).otherwise(2)
    asked = F.col("type").isin(*types) if types else F.lit(True)
    fits = F.lit(True) if direction is None or not types else F.col("type").isin(*symmetric) | F.when(F.lit(direction == "outgoing"), a).otherwise(b)
    top = relations.withColumn("ring", ring).withColumn("_a", ~asked).withColumn("_f", ~fits).orderBy("ring", "_a", "_f", F.col("score").desc(), "edge_id").limit(per_company * len(keys))
    order = W.orderBy("ring", "_a", "_f", F.col("score").desc(), "edge_id")  # of no more rows than the limit
    return top.withColumn("pos", F.row_number().over(order)).drop("_a", "_f")


def end_slots(relations: DataFrame, slots: int = 5) -> DataFrame:
    """(side, pos, key): the first distinct sources and targets in order of score, each side for itself."""
    rows = relations.select("score", "edge_id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("src").alias("key")), F.struct(F.lit("target").alias("side"), F.col("tgt").alias("key")))).alias("e")).select("score", "edge_id", "e.*")
    first = rows.groupBy("side", "key").agg(F.min(F.struct((-F.col("score")).alias("s"), "edge_id")).alias("first"))
    pos = F.row_number().over(W.partitionBy("side").orderBy("first", "key"))
    return first.withColumn("pos", pos).where(F.col("pos") <= slots).select("side", "pos", "key")


def card_order(cards: DataFrame, *, risky: int = 2, fresh: int = 3, limit: int = 10) -> DataFrame:
    """(pos, card_id): two risky cards, three fresh ones in turns of kinds, then all others; within by firms, lift, kind, id.

    cards has card_id, kind, shared, lift. Windows are by group or over what a limit leaves.
    """
    rank = [F.col("shared").desc(), F.col("lift").desc(), F.col("kind"), F.col("card_id")]
    group = F.when(F.col("kind").isin(*RISKY), 0).when(F.col("kind").isin(*FRESH), 1).otherwise(2)
    c = cards.withColumn("g", group)
    kinds = F.array(*map(F.lit, FRESH))
    # Every window is over rows that a limit leaves, or is cut to `fresh` rows per kind before its shuffle.
    top = c.where("g = 0").orderBy(*rank).limit(risky)
    head1 = top.select("card_id", F.lit(0).alias("part"), F.struct(F.lit(0).alias("t"), F.row_number().over(W.orderBy(*rank)).alias("k")).alias("o"))
    turns = c.where("g = 1").withColumn("turn", F.row_number().over(W.partitionBy("kind").orderBy(*rank))).where(F.col("turn") <= fresh)
    head2 = turns.orderBy("turn", F.array_position(kinds, F.col("kind"))).limit(fresh).select("card_id", F.lit(1).alias("part"), F.struct(F.col("turn").alias("t"), F.array_position(kinds, F.col("kind")).cast("int").alias("k")).alias("o"))
    head = head1.unionByName(head2)
    rest = c.join(head.select("card_id"), "card_id", "left_anti").orderBy(*rank).limit(limit)
    rest = rest.withColumn("k", F.row_number().over(W.orderBy(*rank))).select("card_id", F.lit(2).alias("part"), F.struct(F.lit(0).alias("t"), F.col("k")).alias("o"))
    all_ = head.unionByName(rest).orderBy("part", "o").limit(limit)
    return all_.select(F.row_number().over(W.orderBy("part", "o")).alias("pos"), "card_id")


def search(nodes: DataFrame, aliases: DataFrame, registry: DataFrame, degrees: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """(key, name, tier, in_graph, degree): names that hold q, exact before prefix before inside before an alias.

    Of the registry, names that no node has are added behind the graph's. nodes (key, name), aliases (key, alias),
    registry (key, name), degrees (key, degree).
    """
    low, n = q.lower(), F.lower("name")
    tier = F.when(n == low, 0).when(n.startswith(low), 1).when(n.contains(low), 2)
    by_alias = aliases.where(F.lower("alias").contains(low)).select("key").distinct().withColumn("_alias", F.lit(3))
    own = nodes.withColumn("tier", tier).join(by_alias, "key", "left").withColumn("tier", F.coalesce("tier", "_alias")).where("tier is not null")
    own = own.join(degrees, "key", "left").select("key", "name", "tier", F.lit(True).alias("in_graph"), F.coalesce("degree", F.lit(0)).alias("degree"))
    more = registry.withColumn("tier", tier).where("tier is not null").join(nodes.select("key"), "key", "left_anti").select("key", "name", "tier", F.lit(False).alias("in_graph"), F.lit(0).cast("long").alias("degree"))
    return own.unionByName(more).orderBy(F.col("in_graph").desc(), "tier", F.col("degree").desc(), F.length("name"), "name", "key").limit(limit)


def alias_match(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """(candidate, name): the least canonical name under an alias's or a canonical key; two equal joins instead of one with OR."""
    a = aliases.where("canon_name <> ''")
    keys = a.select(F.col("alias_key").alias("k"), "canon_name").unionByName(a.select(F.col("canonical_key").alias("k"), "canon_name"))
    keys = keys.groupBy("k").agg(F.min("canon_name").alias("canon_name"))  # one name per key before the join
    return candidates.join(keys, "k").groupBy("candidate").agg(F.min("canon_name").alias("name"))


def shared_risks(links: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """(event_id, firms, base, coverage): events that touch `least` or more of keys, all firms they touch, and the share in percent."""
    own = F.count_distinct(F.when(F.col("company").isin(*keys), F.col("company")))
    g = links.groupBy("event_id").agg(own.alias("firms"), F.count_distinct("company").alias("base")).where(F.col("firms") >= least)
    return g.withColumn("coverage", F.round((F.col("firms") * 100).cast("decimal(28,6)") / F.col("base").cast("decimal(28,6)"), 1).cast("double"))


def event_sources(links: DataFrame) -> DataFrame:
    """(event_id, source_docs, article_count): what an event's edges name, distinct; bounded by the event's own edges."""
    return links.groupBy("event_id").agg(F.array_sort(F.collect_set("source_doc")).alias("source_docs")).withColumn("article_count", F.size("source_docs").cast("long"))


def merge_signals(events: DataFrame) -> DataFrame:
    """(event_id, signals): why a merged event may be a mixture: subjects, span, timeline, source, years.

    events has event_id, subjects, months, timeline, article_count, source_doc, source_docs, years (arrays but for the
    count and the doc); events without a signal go.
    """
    span = F.coalesce(F.array_max("months") - F.array_min("months"), F.lit(0))
    lone = (F.size("timeline") > 0) & (F.coalesce("article_count", F.lit(0)) <= 1)
    foreign = F.col("source_doc").isNotNull() & ~F.coalesce(F.array_contains("source_docs", F.col("source_doc")), F.lit(False))
    rules = {"S1": F.size(F.array_distinct("subjects")) >= 2, "S2": span >= 4, "S3": lone, "S4": foreign, "S5": F.size(F.array_distinct("years")) >= 2}
    return events.select("event_id", F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()])).alias("signals")).where("size(signals) > 0")


def company_cards(companies: DataFrame, products: DataFrame, customers: DataFrame, vendors: DataFrame, *, most: int = 5) -> DataFrame:
    """(key, card): a firm's card for search: name and sector, its longest product names, some customers and suppliers.

    Each side (key, name) is cut to `most` per firm by rank before it is collected, and aggregated by itself.
    """
    def some(df: DataFrame, name: str, by: Sequence[Column]) -> DataFrame:
        r = F.row_number().over(W.partitionBy("key").orderBy(*by))
        top = df.distinct().withColumn("r", r).where(F.col("r") <= most)
        return top.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), " · ").alias(name))

    j = companies.join(some(products, "p", [F.length("name").desc(), F.col("name")]), "key", "left").join(some(customers, "c", [F.col("name")]), "key", "left").join(some(vendors, "v", [F.col("name")]), "key", "left")
    line = lambda label, c: F.concat(F.lit(label), F.col(c))
    return j.select("key", F.concat_ws("\n", "name", line("업종: ", "sector"), line("주요 제품·기술: ", "p"), line("주요 고객: ", "c"), line("주요 공급사: ", "v")).alias("card"))


def changed_cards(cards: DataFrame, stored: DataFrame) -> DataFrame:
    """Cards whose digest is not the stored one: only these are embedded anew. stored has key, digest."""
    c = cards.withColumn("digest", F.sha2("card", 256))
    return c.join(stored.select("key", "digest"), ["key", "digest"], "left_anti")


def stale_cards(stored: DataFrame, companies: DataFrame) -> DataFrame:
    return stored.join(companies.select("key"), "key", "left_anti")


def cited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, pos, evidence_id): the cited ids that are evidence with a text, in order, each once; invented and missing ones go."""
    rows = claims.select("claim_id", F.posexplode(F.array_distinct("cited")).alias("pos", "evidence_id"))
    return rows.join(evidence.where("not missing").select("evidence_id"), "evidence_id", "left_semi").select("claim_id", "pos", "evidence_id")


def claim_summary(checked: DataFrame) -> DataFrame:
    """One row: number of claims, those uncited, without text and scored, and the least, mean and greatest score to three digits."""
    r = lambda c: F.round(c.cast("decimal(28,10)"), 3).cast("double")
    s = F.col("score")
    return checked.agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "uncited").alias("uncited"), F.count_if(F.col("status") == "no_text").alias("no_text"), F.count(s).alias("scored"), r(F.min(s)).alias("min"), r(F.avg(s)).alias("mean"), r(F.max(s)).alias("max"))


def merged_events(rows: DataFrame) -> DataFrame:
    """(event_id, evidence_ids): one row per event of several tool results (event_id, pos, evidence_ids), evidence at first sight, in order of results."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_ids"))), lambda x: x["evidence_ids"])
    return rows.groupBy("event_id").agg(F.array_distinct(F.flatten(ids)).alias("evidence_ids"))


def company_blocks(companies: DataFrame, **blocks: DataFrame) -> DataFrame:
    """(key, one boolean per block, complete): which blocks of a firm's page have rows. Each block is reduced to its keys first."""
    out = companies.select("key").distinct()
    for name, df in blocks.items():
        out = out.join(df.select("key").distinct().withColumn(name, F.lit(True)), "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("complete", F.array_compact(F.array(*[F.when(F.col(b), F.lit(b)) for b in blocks])))


def market_reason(companies: DataFrame, prices: DataFrame, *, most_shares: float = 2e10) -> DataFrame:
    """(key, listed, reason): why a firm has no market figures: not listed, shares that can't be, not collected; null if it has them.

    companies has key, stock_code, shares; segment figures and the like are shown only where `reason` allows.
    """
    have = prices.select("stock_code").distinct().withColumn("_p", F.lit(True))
    j = companies.join(have, "stock_code", "left")
    odd = F.coalesce((F.col("shares") <= 0) | (F.col("shares") > most_shares), F.lit(False))
    reason = F.when(F.col("stock_code").isNull(), "unlisted").when(odd, "unreliable_shares").when(F.col("_p").isNull(), "not_collected")
    return j.select("key", F.col("stock_code").isNotNull().alias("listed"), reason.alias("reason"))
