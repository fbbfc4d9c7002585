"""The open vocabulary of relations and events as Column functions: forms of subtypes, types of untyped relations, event words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Per edge type the forms of its subtypes in order, each with the parts of words that lead to it.
SUBTYPES = {
    "OWNS_STAKE_IN": {
        "최대주주": ("최대주주", "largestshareholder", "controllingshareholder"),
        "특수관계인": ("특수관계", "친인척", "relatedparty"),
        "자회사": ("subsidiary",),
        "지분투자": ("지분투자", "주식취득", "지분취득", "주식매입", "investment", "acquisition", "stakeacquisition", "equityinvestment"),
        "자기주식": ("자기주식", "자사주", "treasurystock"),
        "지분보유": ("majority", "minority", "partial", "ownership", "joint", "indirect", "100%", "<50%", ">50%"),
    },
    "SUPPLIES_TO": {
        "OEM공급": ("oem",), "ODM공급": ("odm",), "공급계약": ("supplyagreement", "supplycontract"),
        "수주": ("purchaseorder",), "공급": ("supplier", "vendor", "customer", "client"),
    },
    "PARTNERS_WITH": {
        "합작투자": ("jointventure", "jv", "jointinvestment"), "특허크로스라이선스": ("crosslicense",), "특허라이선스": ("patentlicense",),
        "기술이전": ("techtransfer",), "공동개발": ("jointdevelopment", "jointresearch", "productdevelopment", "jointpatentapplication"),
        "업무협약": ("mou",), "기술제휴": ("strategicpartnership", "partnership"), "협력": ("collaboration", "cooperation"),
    },
    "ACQUIRES": {
        "합병": ("합병", "merger"),
        "주식취득": ("주식취득", "지분인수", "주식양수", "경영권인수", "지분매입", "acquisition", "acquisitionprocess", "fullacquisition", "partial", "subsidiary"),
        "영업양수": ("영업양수", "사업양수", "자산양수", "assetacquisition"),
    },
    "SUES": {
        "특허침해": ("특허침해", "특허소송", "지식재산권침해", "patentinfringement", "ipinfringement"), "손해배상": ("손해배상", "배상청구", "damages"),
        "가처분": ("가처분", "금지청구", "injunction"), "특허무효": ("특허무효", "무효심판", "patentinvalidation", "invalidation"),
        "상표침해": ("상표침해", "trademarkinfringement"), "집단소송": ("집단소송", "classaction"),
        "소송": ("lawsuit", "litigation", "complaint", "arbitration", "intellectualproperty", "declaratoryjudgment", "noncompete"),
    },
    "COMPETES_WITH": {"점유율경쟁": ("점유율", "marketshare"), "경쟁": ("competition", "competitor", "rivalry")},
    "REGULATES": {
        "제재": ("제재", "과징금", "시정명령", "처분", "sanction", "penalty", "fine"), "조사": ("조사", "심사", "수사", "investigation", "probe"),
        "판정": ("판정", "판결", "결정", "ruling", "determination", "verdict"), "인허가": ("인허가", "승인", "허가", "인증", "approval", "clearance"),
        "수출규제": ("수출규제", "수출통제", "exportcontrol", "exportrestriction"),
    },
    "DEVELOPS": {
        "공동개발": ("jointdevelopment", "collaboration", "cooperation"), "개발": ("development", "technologydevelopment", "research", "randd", "r&d"),
        "생산": ("production", "manufacturing"), "출시": ("launch", "release"),
    },
    "IS_EXECUTIVE_OF": {
        "대표이사": ("ceo", "chiefexecutive", "representativedirector"), "사장": ("president",), "사내이사": ("internaldirector",),
        "사외이사": ("outsidedirector", "independentdirector"), "최대주주": ("owner", "founder"),
    },
    "DEPENDS_ON": {
        "라이선스": ("license", "라이선스", "실시권"), "매출의존": ("매출의존", "매출비중", "매출"),
        "공급의존": ("공급의존", "기술의존", "부품의존", "부품", "소재", "원자재", "기술", "공정"),
    },
}
#: Subtypes that say nothing.
UNKNOWN = ("other", "미상", "불명", "n/a", "na", "none", "null", "기타", "?", "event", "/", "test", "build", "synergy", "potential", "general", "unknown", "misc", "etc")
#: Expressions of untyped relations, in order of precedence, with the edge type and subtype they stand for.
LEXICON = (
    (r"(?:지분|주식)\s*(?:[\d.,]+\s*(?:%|퍼센트|주|만주|억원)?\s*)?(?:투자|취득|매입|인수|확보)|출자", "OWNS_STAKE_IN", "지분투자"),
    (r"유상\s*증자\s*(?:에\s*)?참여|제3자\s*배정\s*(?:유상)?증자", "OWNS_STAKE_IN", "유상증자"),
    (r"주식\s*양도\s*계약|지분\s*양수도\s*계약", "OWNS_STAKE_IN", "지분양수도"),
    (r"합작\s*(?:법인|회사)?|조인트\s*벤처|joint\s*venture", "PARTNERS_WITH", "합작투자"),
    (r"양해\s*각서|업무\s*협약|\bMOU\b", "PARTNERS_WITH", "업무협약"),
    (r"공동\s*(?:개발|연구)|기술\s*(?:제휴|이전|공여)", "PARTNERS_WITH", "공동개발"),
    (r"(?:피)?인수\s*합병|경영권\s*(?:인수|양수)|흡수\s*합병", "ACQUIRES", "합병"),
    (r"(?:특허|지식\s*재산권?|상표권|저작권)\s*(?:\S{1,12}\s*){0,2}침해", "SUES", "특허침해"),
    (r"소송\s*(?:제기|을\s*제기)|제소|손해\s*배상\s*청구|가처분\s*신청", "SUES", "소송"),
    (r"납품\s*계약|공급\s*계약|수주\s*계약|양산\s*공급", "SUPPLIES_TO", "공급계약"),
    (r"과징금|시정\s*명령|영업\s*정지|제재\s*(?:조치|부과)", "REGULATES", "제재"),
)
#: Parts of the names of regulators, and words of statements that are no lawsuits.
REGULATORS = ("위원회", "공정위", "금감원", "금융감독원", "국세청", "관세청", "경찰", "검찰", "지검", "고검", "대검", "검찰청", "수사부", "수사대", "특수부", "법원", "지법", "고법", "대법원", "산업부", "환경부", "고용노동부", "식약처", "방통위", "특허심판원", "무역위원회", "commission", "itc", "ftc", "sec", "doj", "부처", "청장", "당국")
STATEMENTS = ("요구", "촉구", "항의", "규탄", "성명", "호소", "청원")
#: Words that name an event's kind, in order of precedence; then words of names that tell nothing apart.
UNIQUE_EVENTS = ("화재", "폭발", "붕괴", "누출", "정전", "침수", "사망", "중대재해", "산업재해", "안전사고", "파업", "노동쟁의", "쟁의", "직장폐쇄", "리콜", "결함", "불량", "과징금", "제재", "압수수색", "기소", "고발", "담합", "세무조사", "행정처분", "소송", "가처분", "특허침해", "횡령", "배임", "분쟁", "가동중단", "생산중단", "생산차질", "감산", "셧다운", "적자전환", "어닝쇼크", "상장폐지", "신용등급", "인수", "합병", "매각", "분할", "상장", "갈등", "난항", "교섭", "임단협", "단체협약", "조정신청", "중재", "의혹", "논란", "제소", "고소", "수사")
RECURRING_EVENTS = ("공급계약", "장기계약", "본계약", "계약체결", "계약", "수주", "발주", "납품", "양산", "출하", "생산개시", "증설", "착공", "준공", "가동", "투자", "출자", "유치", "출시", "공개", "개발완료", "인증", "제휴", "협약", "합작", "MOU", "규제", "수출제한", "관세")
NAME_STOP = ("반도체", "사업", "관련", "국내", "글로벌", "신규", "추가", "본격", "확대", "강화", "계획", "추진", "체제", "규모")
#: Latin words with their usual Hangul spelling.
SPELLINGS = {"cosmos": "코스모스", "cookoff": "쿡오프", "summit": "서밋", "forum": "포럼", "expo": "엑스포", "show": "쇼", "week": "위크", "day": "데이", "award": "어워드", "conference": "컨퍼런스", "ces": "씨이에스", "ifa": "이파", "computex": "컴퓨텍스", "semicon": "세미콘", "robot": "로봇", "world": "월드"}
#: The share of the smaller token set that two names of one recurring event have in common.
SAME_NAME = 0.6


def canonical_subtype(edge_type: Column, subtype: Column) -> Column:
    """The form of a subtype: empty if it says nothing, the first form that matches, else the subtype as it is."""
    raw = F.regexp_replace(F.trim(F.coalesce(subtype, F.lit(""))), r"^[.·-]+|[.·-]+$", "")
    flat = F.lower(F.regexp_replace(raw, r"[\s\-_·,.]+", ""))
    out = F.when((raw == "") | F.lower(raw).isin(*UNKNOWN), "")
    for kind, forms in SUBTYPES.items():
        for form, parts in forms.items():
            out = out.when((edge_type == kind) & flat.rlike("|".join(parts)), form)
    return out.otherwise(raw)


def type_of_expression(expression: Column, evidence: Column) -> Column:
    """(type, subtype) of an untyped relation from its expression, else from its evidence; null if neither shows one."""
    found = lambda text: F.coalesce(*[F.when(text.rlike("(?i)" + p), F.struct(F.lit(kind).alias("type"), F.lit(form).alias("subtype"))) for p, kind, form in LEXICON])
    return F.coalesce(found(expression), found(evidence))


def lawsuit_or(source_name: Column, subtype: Column) -> Column:
    """What an edge of type SUES is: REGULATES if a regulator starts it, DROP for a mere statement, else SUES."""
    regulator = F.coalesce(F.lower(source_name).rlike("|".join(REGULATORS)), F.lit(False))
    return F.when(regulator, "REGULATES").when(F.coalesce(subtype.rlike("|".join(STATEMENTS)), F.lit(False)), "DROP").otherwise("SUES")


def event_word(name: Column) -> Column:
    """The first word of the event vocabulary that a name holds, white space aside; null if it holds none."""
    flat = F.regexp_replace(name, r"\s+", "")
    return F.coalesce(*[F.when(F.contains(flat, F.lit(w)), F.lit(w)) for w in UNIQUE_EVENTS + RECURRING_EVENTS])


def event_tokens(name: Column) -> Column:
    """The distinct tokens of an event's name, in upper case; Latin words in their usual Hangul spelling."""
    spell = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    runs = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("([가-힣]+|[A-Za-z0-9]+)"), 1)
    words = F.transform(runs, lambda t: F.upper(F.coalesce(F.try_element_at(spell, F.lower(t)), t)))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*NAME_STOP)))


def event_roots(name: Column) -> Column:
    """Tokens, with the Latin head of mixed ones and the first three syllables of long Hangul ones."""
    head = lambda t: F.nullif(F.regexp_extract(t, "^([0-9A-Z]{2,})", 1), F.lit(""))
    stem = lambda t: F.when(t.rlike("^[가-힣]{4,}$"), F.substring(t, 1, 3))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(event_tokens(name), lambda t: F.array(t, head(t), stem(t))))))


def same_recurring_event(a: Column, b: Column) -> Column:
    """Whether two names share enough tokens; never if either has none."""
    x, y = event_tokens(a), event_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)) >= SAME_NAME).otherwise(False)
