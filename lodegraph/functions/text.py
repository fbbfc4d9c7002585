"""Column functions on names and text. Patterns are Java's; none of these is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms of company names, and words that say nothing when a name is held against evidence.
KOREAN_FORMS = r"㈜|\(\s*주\s*\)|\(\s*유\s*\)|주식회사|유한회사"
ENGLISH_FORMS = ("inc", "ltd", "llc", "corp", "co", "corporation", "company", "limited", "gmbh", "plc", "ag", "sa", "nv", "bv", "kk", "pte", "pty", "sdn", "bhd", "srl", "spa")
STOP_TOKENS = ("주식회사", "코퍼레이션", "그룹", "홀딩스", "사건", "관계", "계약", "co", "ltd", "inc")
#: The topics of news and the words that show them.
TOPICS = {
    "supply": ("공급", "납품", "수주", "계약", "체결", "발주", "조달", "위탁", "외주", "거래", "구매", "공급망", "밸류체인", "협력사", "파트너사", "생산차질", "공장중단", "셧다운", "가동중단"),
    "stake": ("인수", "합병", "피인수", "매각", "양수", "양도", "인수합병", "M&A", "지분", "출자", "투자", "지주", "계열", "자회사", "최대주주", "주주"),
    "regulation": ("과징금", "제재", "압수수색", "기소", "고발", "담합", "공정위", "국세청", "규제", "조사", "행정처분", "시정명령", "과태료"),
    "incident": ("화재", "폭발", "정전", "누출", "붕괴", "리콜", "결함", "불량", "안전사고", "중대재해", "품질문제", "파업", "총파업", "노조", "노동쟁의", "임단협", "쟁의", "태업", "소송", "분쟁"),
}
#: Hangul's initial, medial and final letters in Latin script.
INITIALS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
MEDIALS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
FINALS = ("", "k", "k", "k", "n", "n", "n", "t", "l", "l", "l", "l", "l", "l", "l", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")
#: Endings that a name's skeleton leaves out, and letters that it counts as one, in this order.
NAME_ENDINGS = ("technologies", "technology", "테크놀로지", "테크놀러지", "테크놀로지스", "semiconductor", "세미컨덕터", "corporation", "industries", "materials", "머티리얼즈", "머티어리얼즈", "holdings", "홀딩스", "incorporated", "limited", "group", "그룹", "inc", "ltd", "llc", "co")
FOLDED = (("c", "k"), ("q", "k"), ("x", "ks"), ("v", "b"), ("f", "p"), ("l", "r"), ("z", "j"), ("y", "i"), ("w", "u"), ("d", "t"), ("g", "k"), ("b", "p"), ("sh", "s"))
#: Words that make a name that of a group, and the firms that some groups are called by.
GROUP_ENDINGS = ("그룹", "계열", "일가")
GROUP_FIRMS = {"현대차": "현대자동차", "한화": "한화", "롯데": "롯데지주", "포스코": "포스코홀딩스", "GS": "GS", "CJ": "CJ", "LS": "LS"}


def collapse(c: Column) -> Column:
    """White space as single spaces, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def clean_missing(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin("", "-"), t)


def compact(c: Column) -> Column:
    """Without white space and punctuation, in lower case: what differs only in notation becomes equal."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-_·,.()\[\]]+", ""))


def company_key(c: Column) -> Column:
    """The key under which spellings of a company's name meet: no legal form, footnote, punctuation, case or space."""
    plain = F.regexp_replace(c, KOREAN_FORMS, "")
    plain = F.regexp_replace(plain, r"\(?\s*(주|註)\s*\d+\s*\)|\*+", "")
    tokens = F.filter(F.split(plain, r"[\s,.()\[\]]+"), lambda t: t != "")
    joined = F.array_join(tokens, " ")
    bare = F.regexp_replace(joined, r"(?i)( (" + "|".join(ENGLISH_FORMS) + r"))+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "[,.·'\"`/]+", ""), r"\s+", ""))


def word_trigrams(c: Column) -> Column:
    """The set of trigrams of a text's words, each word with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(0.0)


def registry_trigrams(c: Column) -> Column:
    s = F.concat(F.lit("  "), compact(c), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))


def registry_similarity(a: Column, b: Column) -> Column:
    """1 if equal but for notation; 0 beyond three times the length; 0.9 for a modifier of two letters before; else containment."""
    ca, cb = compact(a), compact(b)
    swap = F.length(ca) <= F.length(cb)
    short, long_ = F.when(swap, ca).otherwise(cb), F.when(swap, cb).otherwise(ca)
    ta, tb = registry_trigrams(a), registry_trigrams(b)
    share = F.size(F.array_intersect(ta, tb)) / F.least(F.size(ta), F.size(tb))
    return F.when((ca == "") | (cb == ""), 0.0).when(ca == cb, 1.0).when(F.length(long_) > 3 * F.length(short), 0.0).when(F.endswith(long_, short), F.when(F.length(long_) - F.length(short) >= 2, 0.9).otherwise(0.0)).otherwise(share)


def name_tokens(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\s\-_·,.()\[\]「」『』/]+"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*STOP_TOKENS))


def overlap(text: Column, tokens: Column) -> Column:
    """The share of tokens that the text holds, whatever its white space and case; 1 without tokens."""
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    held = F.filter(tokens, lambda t: F.contains(flat, F.lower(F.regexp_replace(t, r"\s+", ""))))
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(held) / F.size(tokens))


def title_hash(c: Column) -> Column:
    """Equal for one story under several mastheads: tags before and after the title, signs and spaces do not count."""
    t = F.regexp_replace(c, r"^\s*[\[\(【][^\]\)】]{1,12}[\]\)】]\s*", "")
    t = F.regexp_replace(t, r"\s*[\(（](종합|재종합|속보|영상|사진|전문)\d*[\)）]\s*$", "")
    return F.substring(F.sha1(F.regexp_replace(t, r"(?U)[^\w]", "").cast("binary")), 1, 16)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def registrable_domain(h: Column) -> Column:
    """The last two labels of a host, three under the second levels of Korean registries."""
    p = F.split(h, r"\.")
    n = F.when(h.rlike(r"\.(co|or|go|ac|ne|re|pe)\.kr$"), 3).otherwise(2)
    return F.array_join(F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), n), ".")


def topics(c: Column) -> Column:
    """All topics that a text shows, in their fixed order."""
    found = [F.when(c.rlike("|".join(w.replace("&", "[&]") for w in words)), F.lit(name)) for name, words in TOPICS.items()]
    return F.array_compact(F.array(*found))


def final_letter(c: Column) -> Column:
    """Whether a word's last syllable ends in a consonant; null if it is not Hangul."""
    code = F.ascii(F.right(c, F.lit(1)))
    return F.when((code >= 0xAC00) & (code <= 0xD7A3), (code - 0xAC00) % 28 > 0)


def romanize(c: Column) -> Column:
    """Hangul in Latin letters by code point arithmetic; other letters and digits in lower case."""
    pick = lambda letters, i: F.element_at(F.array(*[F.lit(x) for x in letters]), (i + 1).cast("int"))

    def one(ch: Column) -> Column:
        i = F.ascii(ch) - 0xAC00
        latin = F.concat(pick(INITIALS, F.floor(i / 588)), pick(MEDIALS, F.floor((i % 588) / 28)), pick(FINALS, i % 28))
        return F.when((i >= 0) & (i <= 0xD7A3 - 0xAC00), latin).when(ch.rlike(r"[\p{L}\p{N}]"), F.lower(ch)).otherwise("")

    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), "")


def strip_markup(c: Column) -> Column:
    """Text of markup: scripts, styles and comments go, tags become breaks, entities characters, blanks single."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|nav|section|title)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def repair_xml(c: Column) -> Column:
    """Markup a strict reader would refuse: control characters go, bare & and < become entities."""
    t = F.regexp_replace(c, r"^\s*<\?xml[^>]*\?>", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    t = F.regexp_replace(t, r"&(?!(#\d+|#x[0-9A-Fa-f]+|[A-Za-z]+);)", "&amp;")
    return F.regexp_replace(t, r"<(?![A-Za-z/!?])", "&lt;")


def skeleton(c: Column) -> Column:
    """The consonants of a name in Latin letters: spellings and transliterations of one name meet in it."""
    t = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    cut = t
    for ending in reversed(NAME_ENDINGS):
        cut = F.when(low.endswith(ending) & (F.length(t) > len(ending) + 2), F.substring(t, F.lit(1), F.length(t) - len(ending))).otherwise(cut)
    s = F.when(cut.rlike("[가-힣]"), romanize(cut)).otherwise(F.lower(cut))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]", ""), "eu", "")
    s = F.regexp_replace(s, "s$", "")
    for a, b in FOLDED:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(s, r"(.)\1+", "$1"), "[aeiou]", "")


def dates_to_iso(c: Column) -> Column:
    """Dates within a text as ISO dates: 2026년 3월 18일, 2026.3.18, 2026/03/18; 2026년 3월 as a month."""
    t = F.regexp_replace(c, r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일", "$1-\u00010$2-\u00010$3")
    t = F.regexp_replace(t, r"\b(\d{4})[./](\d{1,2})[./](\d{1,2})\b", "$1-\u00010$2-\u00010$3")
    t = F.regexp_replace(t, r"(\d{4})\s*년\s*(\d{1,2})\s*월", "$1-\u00010$2")
    return F.replace(F.regexp_replace(t, "\u00010(\\d\\d)", "$1"), F.lit("\u0001"), F.lit(""))


def group_firm(c: Column) -> Column:
    """The firm that a group's name stands for: the name without its ending, or the firm the group is called by; else null."""
    firms = F.create_map(*[F.lit(x) for pair in GROUP_FIRMS.items() for x in pair])
    base = F.regexp_extract(c, "^(.+?)\\s*(?:" + "|".join(GROUP_ENDINGS) + ")$", 1)
    return F.when(base != "", F.coalesce(F.element_at(firms, base), base))


def clean_name(c: Column) -> Column:
    """A name in a disclosure without footnotes and notes: white space single, missing marks null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(collapse(clean_missing(c)), r"\(?\s*(주|註)\s*\d+\s*\)|\*+", ""), r"\(\s*\)", "")), F.lit(""))


def clean_lines(c: Column, mark: str = "\n") -> Column:
    """The parts between line feeds, or between bullets, joined by bars; null if nothing is left."""
    parts = F.filter(F.transform(F.split(clean_missing(c), mark), collapse), lambda x: x.isNotNull())
    return F.nullif(F.array_join(parts, " | "), F.lit(""))


def without_names(c: Column, names) -> Column:
    """A label without the given names, white space single: labels are compared without what the question names."""
    for name in names:
        c = F.replace(c, F.lit(name), F.lit(" "))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def route_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def title_key(c: Column) -> Column:
    """A headline for comparison: no tags before it, no entities, quotes, middle dots or white space."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"^(\s*[\[〈<【][^\]〉>】]{1,20}[\]〉>】]\s*)+", "")
    return F.regexp_replace(F.regexp_replace(t, "[\"'‘’“”·ㆍ]", ""), r"\s+", "")
