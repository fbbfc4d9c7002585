"""Claims of an answer against the evidence that they cite: words, causes, attribution, and the link to the question.

Nothing here is a verdict. A claim is scored by the share of its words that its own cited evidence holds, all of it
taken together; what is missing is listed. A second pass names the firms that the claim speaks of and its evidence does
not, or only in the headline that is attached to an article's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import skew_join

#: Expressions of cause, words of sentences that tell nothing apart, and event types that say nothing.
CAUSES = ("로 인해", "으로 인해", "때문에", "탓에", "결과로", "영향을 미", "영향으로", "여파로", "초래", "야기", "때문", "덕분에", "따라 ", "를 위해", "을 위해")
SENTENCE_STOP = ("발생", "진행", "기록", "관련", "제기", "직면", "상황", "기업", "회사", "사례", "경우", "시작", "완료", "공식", "규모", "체계", "이후", "처음", "보도", "발표", "확인", "예정", "가능", "존재", "대한", "위한")
UNCLASSIFIED = ("기타",)
#: Fixed value: what stands between the text of an article and its headline.
HEADLINE = "\n\n— 「"
#: The share of an effect's words from which the evidence itself states it.
EFFECT_STATED = 0.5
#: Endings of words that are taken off, if two letters remain: particles, and endings of verbs made of nouns.
PARTICLES = ("으로부터", "에서는", "에서도", "에게서", "으로는", "이라는", "에서", "에게", "으로", "까지", "부터", "처럼", "보다", "마다", "라는", "에는", "에도", "와의", "과의", "이나", "에", "의", "은", "는", "이", "가", "을", "를", "와", "과", "도", "로", "만")
VERB_ENDINGS = ("했습니다", "됐습니다", "합니다", "됩니다", "입니다", "하였다", "되었다", "했으며", "했다", "됐다", "한다", "된다", "하는", "되는", "하고", "되고", "하여", "하며", "하기", "되어", "했고", "이다")
BARE_VERBS = ("있다", "없다", "있는", "없는", "있습니다", "있으며", "한다", "했다")
ISO = r"\d{4}-\d{2}(?:-\d{2})?"


def stripped(token: Column) -> Column:
    """A word without the longest ending that leaves two letters."""
    return F.regexp_replace(token, "^(.{2,}?)(?:" + "|".join(VERB_ENDINGS + PARTICLES) + ")$", "$1")


def sentence_tokens(text: Column) -> Column:
    """The words of a sentence that count: ISO dates whole, then words without endings, of two letters or more."""
    dates = F.regexp_extract_all(text, F.lit(f"({ISO})"), 1)
    words = F.transform(T.name_tokens(F.regexp_replace(text, ISO, " ")), stripped)
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*T.STOP_TOKENS) & ~w.isin(*SENTENCE_STOP, *BARE_VERBS))
    return F.concat(dates, kept)


def flat(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def not_held(tokens: Column, flat_text: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.contains(flat_text, flat(t)))


def share(tokens: Column, missing: Column) -> Column:
    return F.when(F.size(tokens) == 0, 1.0).otherwise(1 - F.size(missing) / F.size(tokens))


def effect_clause(text: Column) -> Column:
    """What follows the expression of cause that ends first; empty without one."""
    ends = [F.when(F.instr(text, c) > 0, F.instr(text, c) + len(c)) for c in CAUSES]
    return F.coalesce(F.regexp_replace(F.substr(text, F.least(*ends)), r"^\s+|\s+$", ""), F.lit(""))


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?。\\n]+"), lambda c: F.trim(c)), lambda c: c != "")


def cited_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, texts, types): what each claim's citations lead to, in their order; ids that lead nowhere have no text.

    texts are structs (evidence_id, text, shown): shown is the text with the day of publication, as a reader saw it. A
    claim cites few ids, so its row is small; an evidence that a great share of claims cite is broadcast.
    """
    rows = claims.select("claim_id", F.posexplode(F.array_distinct("cited")).alias("pos", "evidence_id"))
    there = ~F.coalesce("missing", F.lit(False)) & (F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") != "")
    shown = F.concat("text", F.when(F.col("published_at") != "", F.concat(F.lit("\n"), "published_at")).otherwise(""))
    shown = F.when(there, F.struct("evidence_id", "text", F.coalesce(shown, F.col("text")).alias("shown")))
    rows = skew_join(rows, evidence.select("evidence_id", shown.alias("t"), "event_types"), "evidence_id", "left")
    ordered = F.array_compact(F.sort_array(F.collect_list(F.struct("pos", "t")))["t"])
    return rows.groupBy("claim_id").agg(ordered.alias("texts"), F.array_distinct(F.flatten(F.collect_list("event_types"))).alias("types"))


def check(claims: DataFrame, evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per claim: status, score, missing, claim_type, effect_score, misattributed, title_only, intent_linked, best_evidence, best_clause, best_share.

    claims (claim_id, answer_id, text, cited), evidence (evidence_id, text, published_at, missing, event_types), one row
    per id, contexts (answer_id, targets, names, matched): the firms that propagation reaches, those of the workspace,
    and the event types that the question asks for.

    status is uncited without ids, no_text if no id has a text, else scored. claim_type is null unless the claim states
    a cause: propagation if it names a target, free_combination if its effect is not in the evidence. intent_linked
    is null where the question asks for no type or the evidence has none. best_* is the clause of the cited evidence
    that holds the greatest share of the claim's words, the first of equals. Null texts count as empty.
    """
    none = F.array().cast("array<string>")
    own = claims.select("claim_id", "answer_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.array_compact("cited"), none).alias("cited"))
    found = cited_evidence(own, evidence)
    rows = own.join(found, "claim_id", "left")
    rows = skew_join(rows, contexts, "answer_id", "left")
    filled = {c: F.coalesce(c, none) for c in ("types", "targets", "names", "matched")}
    rows = rows.withColumns({**filled, "texts": F.coalesce("texts", F.array().cast("array<struct<evidence_id:string,text:string,shown:string>>"))})

    pool = F.array_join(F.col("texts")["shown"], "\n")
    rows = rows.withColumns({"tokens": sentence_tokens(T.dates_to_iso(F.col("text"))), "pool": flat(T.dates_to_iso(pool)), "effect": T.dates_to_iso(effect_clause(F.col("text")))})
    rows = rows.withColumns({"missing": not_held(F.col("tokens"), F.col("pool")), "effect_tokens": sentence_tokens(F.col("effect"))})
    status = F.when(F.size("cited") == 0, "uncited").when(F.size("texts") == 0, "no_text").otherwise("scored")
    scored = status == "scored"

    effect = share(F.col("effect_tokens"), not_held(F.col("effect_tokens"), F.col("pool")))
    aimed = F.exists("targets", lambda t: (t != "") & F.contains(F.col("text"), t))
    weighed = (F.col("effect") != "") & ~aimed & (F.size("texts") > 0) & (F.size("effect_tokens") > 0)
    kind = F.when(F.col("effect") == "", None).when(aimed, "propagation").when(F.size("texts") == 0, "free_combination").when(weighed & (effect < EFFECT_STATED), "free_combination")

    bodies = F.transform("texts", lambda t: F.substring_index(t["text"], HEADLINE, 1))
    spoken = F.filter("names", lambda n: (n != "") & F.contains(F.col("text"), n) & ~F.exists(bodies, lambda b: F.contains(b, n)))
    in_title = lambda n: F.exists("texts", lambda t: F.contains(t["shown"], n))
    types = F.array_except("types", F.array(*map(F.lit, UNCLASSIFIED)))
    linked = F.when((F.size("matched") > 0) & (F.size(types) > 0), F.arrays_overlap(types, F.col("matched")))

    of_clause = lambda t: F.transform(clauses(t["text"]), lambda c, i: F.struct(share(F.col("tokens"), not_held(F.col("tokens"), flat(T.dates_to_iso(c)))).alias("share"), (-i).alias("at"), t["evidence_id"].alias("id"), c.alias("clause")))
    by_text = F.transform("texts", lambda t, k: F.transform(of_clause(t), lambda c: F.struct(c["share"].alias("share"), (-k).alias("k"), c["at"].alias("at"), c["id"].alias("id"), c["clause"].alias("clause"))))
    best = F.array_max(F.flatten(by_text))
    return rows.select(
        "claim_id", status.alias("status"), F.when(scored, share(F.col("tokens"), F.col("missing"))).alias("score"), F.when(scored, F.col("missing")).otherwise(none).alias("missing"),
        kind.alias("claim_type"), F.when(weighed, effect).alias("effect_score"),
        F.when(scored, F.filter(spoken, lambda n: ~in_title(n))).otherwise(none).alias("misattributed"), F.when(scored, F.filter(spoken, in_title)).otherwise(none).alias("title_only"),
        linked.alias("intent_linked"), best["id"].alias("best_evidence"), best["clause"].alias("best_clause"), best["share"].alias("best_share"),
    )


def summary(checked: DataFrame) -> DataFrame:
    """One row of counts, and of least, mean and greatest score to three digits."""
    some = lambda c: F.count_if(F.size(c) > 0)
    r = lambda c: F.round(c.cast("decimal(28,10)"), 3).cast("double")
    s = F.col("score")
    return checked.agg(
        F.count("*").alias("claims"), F.count_if(F.col("status") == "uncited").alias("uncited"), F.count_if(F.col("status") == "no_text").alias("no_text"), F.count(s).alias("scored"),
        r(F.min(s)).alias("min"), r(F.avg(s)).alias("mean"), r(F.max(s)).alias("max"),
        F.count_if(F.col("claim_type") == "propagation").alias("propagation"), F.count_if(F.col("claim_type") == "free_combination").alias("free_combination"),
        some("misattributed").alias("misattributed"), some("title_only").alias("title_only"), F.count_if(~F.col("intent_linked")).alias("unlinked"), F.count_if(F.col("intent_linked").isNull()).alias("link_unknown"),
    )
