"""Events that are one under several names: candidates by an inverted index, and groups that honour what must stay apart.

Two events are candidates if they touch a company in common and enough of the roots of their names agree; roots of
company names don't count. Some may not be merged: their subjects are known and disjoint, or one of them recurs
(a fire, a strike) and both together would span a year or more. These conditions are on groups, so closing
the candidate pairs to components would break them: A may join B and B join C, though A and C exclude each other.

So pairs are taken in order, the most alike first, and each is judged on the groups as they then are. Many pairs can be
taken at once: one that comes first among all pairs of either group it ties can be decided, as no pair before it
touches these groups. The result is that of taking the pairs one by one. Equally alike pairs are ordered by a hash, so
rounds are few. There is no limit of time between candidates.

Pairs grow with the square of like events at a company. Where conflicts last, as no event has two subjects, they are not
listed: the order is cut to ranges, whose pairs are made from the groups of the ranges before (by_range). Listed pairs
are closed by components, as those of different ones never touch: components of up to MOST_PAIRS pairs are each taken
one by one in a task; only larger ones need rounds. Within a round, groups that lie together are a task's cell, in which
pairs are taken one by one until one waits for a pair that leads elsewhere.
"""

from __future__ import annotations

import math
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions import vocabulary as VO
from ..sources.graph import dealt
from .resolution import connected
from .skew import skew_join

#: Words of events that happen again in another year, and the months from which it is another one.
RECURRENT = ("화재", "폭발", "붕괴", "누출", "정전", "침수", "사망", "중대재해", "산업재해", "안전사고", "파업", "노동쟁의", "쟁의", "직장폐쇄", "임단협", "단체협약", "교섭", "리콜", "결함", "불량", "과징금", "제재", "압수수색", "세무조사", "행정처분", "담합", "실적", "적자", "어닝쇼크", "배당", "자사주")
MOST_MONTHS = 12
#: Pairs of a component up to which it is closed in one task.
MOST_PAIRS = 400_000


def recurs(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(name, r"\s+", "").rlike("|".join(RECURRENT)), F.lit(False))


def prepared(events: DataFrame, index=None) -> DataFrame:
    """(event_id, companies, subjects, roots, low, high, recurs) of events (event_id, name, companies, subjects, dates).

    roots are sorted and without those of any company's name; low and high are the first and last month, null without
    a date. index writes a table that is read more than once.
    """
    index = index or (lambda df: df)
    some = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    months = F.array_compact(F.transform(F.coalesce("dates", F.array().cast("array<string>")), V.month_number))
    e = index(events.select("event_id", some("companies").alias("companies"), some("subjects").alias("subjects"), VO.event_roots(F.col("name")).alias("all"), F.array_min(months).alias("low"), F.array_max(months).alias("high"), recurs(F.col("name")).alias("recurs")))
    of_companies = e.select(F.explode("companies").alias("c")).distinct().select(F.explode(VO.event_roots(F.col("c"))).alias("root")).distinct().withColumn("named", F.lit(True))
    roots = skew_join(e.select("event_id", F.explode("all").alias("root")), of_companies, "root", "left").where("named IS NULL")
    return e.drop("all").join(roots.groupBy("event_id").agg(F.array_sort(F.collect_set("root")).alias("roots")), "event_id")


def signatures(events: DataFrame) -> DataFrame:
    """prepared events by all that is compared: sig is the least event of those that agree in it; sigs stand for their events."""
    same = ["companies", "subjects", "roots", "low", "high", "recurs"]
    return events.groupBy(*same).agg(F.min("event_id").alias("sig"), F.count("*").alias("n"))


def alike_sets(sigs: DataFrame, *carried, least: float, index) -> tuple[DataFrame, DataFrame]:
    """(at, met) of sigs (sig, companies, roots): at (sig, kind, company) has the sets of roots, told by kind, at each company.

    met (company, x, y, alike, mx, my) are the kinds at a company that share enough roots, each with its sigs there;
    at has the carried columns too.
    """
    s = sigs.where((F.size("companies") > 0) & (F.size("roots") > 0))
    sets = s.groupBy("roots").agg(F.min("sig").alias("kind"), F.count("*").alias("n"))
    posted = sets.select("kind", "n", F.explode("roots").alias("root"))
    rare = posted.groupBy("root").agg(F.sum("n").alias("df"))
    ordered = skew_join(posted, rare, "root").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("df", "root")))["root"].alias("roots"))
    at = index(s.join(sets.select("roots", "kind"), "roots").select("sig", "kind", *carried, F.explode("companies").alias("company")))
    many = index(at.groupBy("company", "kind").agg(F.count("*").alias("m")))
    held = many.join(ordered, "kind").select("company", "kind", "m", "roots", F.size("roots").alias("n"))
    prefix = F.slice("roots", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    short = held.select("company", F.col("kind").alias("x"), F.col("m").alias("mx"), F.col("n").alias("nx"), F.col("roots").alias("rx"), F.explode(prefix).alias("root"))
    long_ = held.select("company", F.col("kind").alias("y"), F.col("m").alias("my"), F.col("n").alias("ny"), F.col("roots").alias("ry"), F.explode("roots").alias("root"))
    cores = 4 * sigs.sparkSession.sparkContext.defaultParallelism  # few rows that meet many: not to be merged to a task
    met = short.repartition(cores, "company", "root").join(long_.repartition(cores, "company", "root"), ["company", "root"]).where((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") <= F.col("y"))))
    # met under its first common root only, so sets are compared once per company
    both = F.array_intersect("rx", "ry")
    met = met.where(F.element_at(both, 1) == F.col("root")).withColumn("alike", F.size(both) / F.col("nx")).where(F.col("alike") >= least)
    return at, index(met.select("company", "x", "y", F.round("alike", 3).alias("alike"), "mx", "my"))


def candidates(sigs: DataFrame, *, least: float = 0.6, index=None) -> DataFrame:
    """(a, b, alike): pairs of sigs, a < b, with a company in common and at least this share of the smaller one's roots.

    Whichever has fewer roots must share one of its rarest: of n roots, n - ceil(least n) + 1 are enough to look at. So
    only these are joined with all roots of others at the same company, frequent roots being met last. What is compared
    are the different sets of roots at a company; sigs join their sets' pairs after. If sigs have low, high and recurs,
    pairs that recur and span too long are left out, as no group may ever hold them. index writes tables that are read
    more than once.
    """
    index = index or (lambda df: df)
    dated = [F.struct("low", "high", "recurs").alias("of")] if "recurs" in sigs.columns else []
    at, met = alike_sets(sigs, "companies", *dated, least=least, index=index)
    total, half = met.agg(F.coalesce(F.sum(F.col("mx") * F.col("my")), F.lit(0)), F.coalesce(F.sum("mx"), F.lit(0))).first()
    side = lambda kind, end: at.withColumnsRenamed({"kind": kind, "sig": end, "companies": f"c{end}", "of": f"of_{end}"})
    one = dealt(met.select("company", "x", "y", "alike"), half, "company", "x").join(side("x", "p"), ["company", "x"])
    two = dealt(one, total, "company", "y").join(side("y", "q"), ["company", "y"])
    # and pairs under their first common company only
    out = two.where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q"))).where(F.element_at(F.array_intersect("cp", "cq"), 1) == F.col("company"))
    if dated:
        out = out.where(~too_long("of_p", "of_q"))
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "alike")


def too_long(a: str, b: str) -> Column:
    """Whether two groups (low, high, recurs) recur and span too long together, which no later member mends."""
    span = F.greatest(f"{a}.high", f"{b}.high") - F.least(f"{a}.low", f"{b}.low")
    return (F.col(f"{a}.recurs") | F.col(f"{b}.recurs")) & (F.coalesce(span, F.lit(0)) >= MOST_MONTHS)


def conflict(a: str, b: str) -> Column:
    """Whether two groups (subjects, low, high, recurs) may not become one."""
    apart = (F.size(f"{a}.subjects") > 0) & (F.size(f"{b}.subjects") > 0) & ~F.arrays_overlap(f"{a}.subjects", f"{b}.subjects")
    return apart | too_long(a, b)


def one_by_one(pairs: pd.DataFrame, nodes: pd.DataFrame, *, lasting: bool) -> pd.DataFrame:
    """(x, y, into): pairs (x, y, s, h, a, b) of nodes (node, subjects, low, high, recurs, ts, th, ta, tb) in order s, h, a, b.

    ts to tb are a node's first pair that ends elsewhere, if any: a pair that comes later for either of its groups waits,
    and so does what comes after it for both. Rows with into are nodes x and their group y, others are refused pairs;
    if conflicts are lasting these need not be told.
    """
    number = lambda c: [None if v != v else int(v) for v in nodes[c].astype("float64").tolist()]
    name, kept = nodes["node"].tolist(), {}
    one = [kept.setdefault(t, frozenset(t)) for t in map(tuple, nodes["subjects"])]  # a set each would be most of the memory
    states = list(zip(one, number("low"), number("high"), nodes["recurs"].astype(bool).tolist(), strict=True))
    till = [None] * len(name)
    if nodes["ta"].notna().any():
        till = [None if pd.isna(t[2]) else (float(t[0]), int(t[1]), t[2], t[3]) for t in nodes[["ts", "th", "ta", "tb"]].itertuples(index=False, name=None)]
    up, size, least = list(range(len(name))), [1] * len(name), list(name)

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    pairs, at = pairs.sort_values(["s", "h", "a", "b"]), pd.Index(name)
    first = pairs[["s", "h", "a", "b"]].itertuples(index=False, name=None) if any(till) else repeat(None)  # only what waits is compared
    order = list(zip(at.get_indexer(pairs["x"]).tolist(), at.get_indexer(pairs["y"]).tolist(), first))  # noqa: B905
    between = None if lasting else [{} for _ in name]
    if not lasting:
        for i, (x, y, _) in enumerate(order):
            between[x].setdefault(y, []).append(i)
            between[y].setdefault(x, []).append(i)
    dead, out = set(), []
    for i, (x, y, o) in enumerate(order):
        x, y = top(x), top(y)
        if x == y or i in dead:
            continue
        before = [t for t in (till[x], till[y]) if t is not None and t < o]
        if before:
            till[x], till[y] = (o if till[z] is None else min(till[z], o) for z in (x, y))
            continue
        (sx, lx, hx, rx), (sy, ly, hy, ry) = states[x], states[y]
        low, high = (f((v for v in p if v is not None), default=None) for f, p in ((min, (lx, ly)), (max, (hx, hy))))
        if (sx and sy and not sx & sy) or ((rx or ry) and low is not None and high - low >= MOST_MONTHS):
            if not lasting:
                dead.update(between[x].pop(y))
                del between[y][x]
            continue
        if size[x] < size[y]:
            x, y = y, x
        up[y], states[x], least[x] = x, (sx | sy, low, high, rx or ry), min(least[x], least[y])
        size[x] += size[y]
        till[x] = min((t for t in (till[x], till[y]) if t is not None), default=None)
        if not lasting:
            for z, js in between[y].items():
                del between[z][y]
                if z != x:
                    between[x][z] = between[z][x] = between[x].get(z, []) + js
            between[y] = {}
    out = [(n, least[top(i)], True) for i, n in enumerate(name)] + [(name[order[i][0]], name[order[i][1]], False) for i in sorted(dead)]
    return pd.DataFrame(out, columns=["x", "y", "into"])


STATE = ["subjects", "low", "high", "recurs"]


def in_cells(nodes: DataFrame, pairs: DataFrame, cell: str, *, lasting: bool) -> DataFrame:
    """one_by_one() in every cell of nodes (node, subjects, low, high, recurs, till) and pairs (x, y, o)."""
    kind = nodes.schema["node"].dataType.simpleString()
    flat = lambda o, names: [F.col(f"{o}.{c}").alias(n) for c, n in zip("shab", names)]
    n = nodes.select(cell, "node", *STATE, *flat("till", ["ts", "th", "ta", "tb"]))
    p = pairs.select(cell, "x", "y", *flat("o", "shab"))
    run = lambda key, q, m: one_by_one(q, m, lasting=lasting)
    return p.groupBy(cell).cogroup(n.groupBy(cell)).applyInPandas(run, f"x {kind}, y {kind}, into boolean")


def met_once(pairs: DataFrame, groups: DataFrame, *, lasting: bool) -> DataFrame:
    """(x, y, o): pairs of groups, x < y, by the first pair that ties them; if conflicts are lasting, none in conflict."""
    e = pairs.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("o").alias("o"))
    if lasting:
        side = lambda end, of: groups.select(F.col("grp").alias(end), F.struct(*STATE).alias(of))
        e = e.join(side("x", "p"), "x").join(side("y", "q"), "y").where(~conflict("p", "q")).select("x", "y", "o")
    return e


def grown(groups: DataFrame) -> DataFrame:
    """States (grp, subjects, low, high, recurs) of one row per group, from those of its parts."""
    return groups.groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("subjects"))).alias("subjects"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("recurs").alias("recurs"))


def moved(df: DataFrame, into: DataFrame, c: str) -> DataFrame:
    return df.join(into.withColumnsRenamed({"old": c, "new": "_new"}), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")


def closed(nodes: DataFrame, pairs: DataFrame, checkpoint, *, most_pairs: int | None = None) -> DataFrame:
    """(node, grp): the nodes of pairs (a, b, alike), grouped by taking the pairs the most alike first; grp is the least node.

    nodes have node, subjects, low, high, recurs. A pair that ties two groups in conflict is refused, and with it every
    pair that ties the same two groups then.

    Where no node has two subjects, neither has a group, and a conflict lasts: then pairs are taken by levels of
    likeness, groups of the levels before standing for their nodes, which leaves few pairs of the lower levels. Other
    components, where a third group may end a conflict, take all pairs together.
    """
    most = MOST_PAIRS if most_pairs is None else most_pairs
    e = checkpoint(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct((-F.col("alike")).alias("s"), F.xxhash64("a", "b").alias("h"), "a", "b").alias("o")))
    ends = e.select(F.col("x").alias("node")).union(e.select("y")).distinct()
    g = checkpoint(nodes.join(ends, "node", "left_semi").select(F.col("node").alias("grp"), *STATE))
    several = g.where(F.size("subjects") > 1)
    if several.isEmpty():
        return by_levels(g, e, checkpoint, most)
    component = checkpoint(connected(e.select(F.col("x").alias("a"), F.col("y").alias("b")), checkpoint))
    mixed = checkpoint(component.join(several, component["node"] == several["grp"], "left_semi").select("component").distinct())
    part = lambda how: component.join(mixed, "component", how)
    of = lambda how: (g.join(part(how), F.col("grp") == F.col("node"), "left_semi"), e.join(part(how), F.col("x") == F.col("node"), "left_semi"))
    (ga, ea), (gb, eb) = of("left_semi"), of("left_anti")
    return settled(ga, checkpoint(met_once(ea, ga, lasting=False)), checkpoint, most, lasting=False).unionByName(by_levels(checkpoint(gb), checkpoint(eb), checkpoint, most))


def by_levels(groups: DataFrame, pairs: DataFrame, checkpoint, most: int) -> DataFrame:
    """closed() for groups (grp, subjects, low, high, recurs) and pairs (x, y, o) whose conflicts last.

    Levels are likenesses to three places, a thousand at the most; small ones are taken together.
    """
    levels = pairs.groupBy(F.col("o.s").alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()
    spans, held = [], 0
    for s, n in levels:
        if spans and held + n <= most:
            spans[-1][1], held = s, held + n
        else:
            spans.append([s, s])
            held = n
    g, member = groups, groups.select(F.col("grp").alias("node"), "grp")
    for low, high in spans:
        e = pairs.where(F.col("o.s").between(low, high))
        for end in "xy":
            e = e.join(member.select(F.col("node").alias(end), F.col("grp").alias("_grp")), end).drop(end).withColumnRenamed("_grp", end)
        into = checkpoint(settled(g, checkpoint(met_once(e, g, lasting=True)), checkpoint, most, lasting=True).where("node <> grp").select(F.col("node").alias("old"), F.col("grp").alias("new")))
        g, member = checkpoint(grown(moved(g, into, "grp"))), checkpoint(moved(member, into, "grp"))
    return member


def by_range(sigs: DataFrame, checkpoint, *, least: float, most: int | None = None) -> DataFrame:
    """(node, grp): closed() over candidates() of sigs whose conflicts last, without a table of all their pairs.

    The order of pairs is cut to ranges, by likeness and then by hash, of about `most` pairs of groups that may still
    become one. A range's pairs are made when its turn comes, from the groups as they then are, so pairs within a group
    or in conflict are never listed, and of those between two groups there is only the first. Sigs are told by numbers
    in the order of their names.
    """
    most = max(MOST_PAIRS if most is None else most, 1)
    s = checkpoint(sigs.orderBy("sig").withColumnRenamed("sig", "word").withColumn("sig", F.monotonically_increasing_id()))
    at, met = alike_sets(s, "word", least=least, index=checkpoint)
    spots = checkpoint(at.select("company", "kind").distinct().withColumn("spot", F.monotonically_increasing_id()))
    at = checkpoint(at.join(spots, ["company", "kind"]).select("sig", "word", "spot"))
    spot = lambda kind, name: spots.withColumnsRenamed({"kind": kind, "spot": name})
    met = checkpoint(met.join(spot("x", "sx"), ["company", "x"]).join(spot("y", "sy"), ["company", "y"]).select("sx", "sy", (-F.col("alike")).alias("s"), "mx", "my"))
    levels = met.groupBy("s").agg(F.sum(F.col("mx") * F.col("my")).alias("n"), F.sum("mx").alias("half")).orderBy("s").collect()
    g = checkpoint(s.select(F.col("sig").alias("grp"), *STATE))
    member = g.select(F.col("grp").alias("node"), "grp")
    sizes = [n for _, n, _ in levels]
    start, share, count = 0.0, 1.0, s.count()
    groups = count
    while start < len(levels):
        end = range_end(start, 1.5 * most / share, sizes)
        placed = checkpoint(at.join(member, at["sig"] == member["node"]).join(g, "grp").select("spot", "grp", "sig", "word", F.get("subjects", F.lit(0)).alias("subject"), "low", "high", "recurs"))
        e = checkpoint(live_pairs(met, placed, levels, start, end, checkpoint, coarse=4 * groups < count))
        n = e.count()
        while n > 2 * most and end - start > 1e-12:  # more than the range before let expect: the rest is made again later
            end = start + (end - start) * most / n
            e = e.where((F.col("o.s") <= levels[math.ceil(end) - 1][0]) & F.col("o.h").between(*hashes(F.col("o.s"), levels, start, end)))
            n = e.count()
        share = min(max(n, 1) / of_range(start, end, sizes), 1.0)
        if n:
            into = checkpoint(settled(g, e, checkpoint, 2 * most, lasting=True).where("node <> grp").select(F.col("node").alias("old"), F.col("grp").alias("new")))
            g, member = checkpoint(grown(moved(g, into, "grp"))), checkpoint(moved(member, into, "grp"))
            groups = g.count()
        start = end
    words = lambda c: s.select(F.col("sig").alias(c), F.col("word").alias(f"_{c}"))
    return member.join(words("node"), "node").join(words("grp"), "grp").select(F.col("_node").alias("node"), F.col("_grp").alias("grp"))


def of_range(start: float, end: float, sizes: list[int]) -> float:
    """What lies between two places in the order: the whole part of a place is a level, the rest a share of its hashes."""
    return sum(n * max(min(end, i + 1) - max(start, i), 0) for i, n in enumerate(sizes))


def range_end(start: float, most: float, sizes: list[int]) -> float:
    """The place up to which `most` lie behind start; the end of a level, if that is near."""
    i = int(start)
    while i < len(sizes):
        rest = sizes[i] * (i + 1 - max(start, i))
        if rest > most:
            return max(start, i) + most / sizes[i]
        most -= rest
        i += 1
    return float(len(sizes))


def hashes(s: Column, levels: list, start: float, end: float) -> tuple[Column, Column]:
    """The first and the last hash of a level's pairs between two places in the order, which lie in it or about it."""
    place = lambda v: int((v - int(v)) * 2**64) - 2**63
    first, last = F.lit(-(2**63)), F.lit(2**63 - 1)
    first = F.when(s == levels[int(start)][0], place(start)).otherwise(first)
    if end < len(levels):
        at = levels[int(end)][0]
        last = F.when(s < at, last).otherwise(max(place(end) - 1, -(2**63)))
    return first.cast("long"), last.cast("long")


def live_pairs(met: DataFrame, placed: DataFrame, levels: list, start: float, end: float, checkpoint, *, coarse: bool) -> DataFrame:
    """(x, y, o): pairs of groups that may become one, by the first pair of sigs between two places in the order that ties them.

    If coarse, groups at a spot meet before their sigs do, which pays where groups are few; the result is the same.
    """
    upto = levels[int(start) : math.ceil(end)]
    first, last = hashes(F.col("s"), levels, start, end)
    m = met.where(F.col("s").between(upto[0][0], upto[-1][0])).select("sx", "sy", "s", first.alias("first"), last.alias("last"))
    total, half = sum(n for _, n, _ in upto), sum(n for _, _, n in upto)
    state = ["spot", "grp", "subject", "low", "high", "recurs"]
    p, q = placed.alias("p"), placed.alias("q")
    may = (F.col("p.grp") != F.col("q.grp")) & ((F.col("sx") != F.col("sy")) | (F.col("p.grp") < F.col("q.grp"))) & ~(F.coalesce(F.col("p.subject") != F.col("q.subject"), F.lit(False)) | too_long("p", "q"))
    ends = lambda u, v: (F.col(u) == F.col(f"{v}.spot"))
    if coarse:
        held = checkpoint(placed.groupBy(*state).agg(F.count("*").alias("n")))
        u, v = held.alias("p"), held.alias("q")
        both = dealt(dealt(m, half, "sx").join(u, ends("sx", "p")), half, "sy").join(v, ends("sy", "q") & may)
        m = checkpoint(both.select("sx", "sy", "s", "first", "last", F.col("p.grp").alias("gx"), F.col("q.grp").alias("gy"), (F.col("p.n") * F.col("q.n")).alias("n"), F.col("p.n").alias("half")))
        total, half = m.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("half"), F.lit(0))).first()
        one = dealt(m.drop("n", "half"), half, "sx", "gx").join(p, ends("sx", "p") & (F.col("gx") == F.col("p.grp")))
        one, meet = dealt(one, total, "sy", "gy"), ends("sy", "q") & (F.col("gy") == F.col("q.grp"))
    else:
        one, meet = dealt(dealt(m, half, "sx").join(p, ends("sx", "p")), total, "sy"), ends("sy", "q") & may
    h = F.xxhash64(F.least("p.word", "q.word"), F.greatest("p.word", "q.word"))
    # hashed last, and in the join, as most pairs end there
    two = one.join(q, meet & h.between(F.col("first"), F.col("last")))
    o = F.struct("s", h.alias("h"), F.least("p.sig", "q.sig").alias("a"), F.greatest("p.sig", "q.sig").alias("b"))
    found = checkpoint(two.select(F.least("p.grp", "q.grp").alias("x"), F.greatest("p.grp", "q.grp").alias("y"), o.alias("o")))
    return found.groupBy("x", "y").agg(F.min("o").alias("o"))


def settled(groups: DataFrame, e: DataFrame, checkpoint, most: int, *, lasting: bool) -> DataFrame:
    """(node, grp) of groups by pairs (x, y, o): components of up to `most` pairs in a task each, larger ones in rounds."""
    total = e.count()
    none = F.lit(None).cast(e.schema["o"].dataType)
    n = groups.withColumnRenamed("grp", "node").withColumn("till", none)
    if total <= most:
        n = n.join(e.select(F.col("x").alias("node")).union(e.select("y")).distinct(), "node", "left_semi")
        out = in_cells(n.withColumn("component", F.lit(0)), e.withColumn("component", F.lit(0)), "component", lasting=lasting)
        return out.where("into").select(F.col("x").alias("node"), F.col("y").alias("grp"))
    component = checkpoint(connected(e.select(F.col("x").alias("a"), F.col("y").alias("b")), checkpoint))
    n = n.join(component, "node")
    e = checkpoint(e.join(component.withColumnRenamed("node", "x"), "x"))
    large = checkpoint(e.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component"))
    apart = lambda df: df.join(large, "component", "left_anti")
    out = in_cells(apart(n), dealt(apart(e), total, "component"), "component", lasting=lasting).where("into").select(F.col("x").alias("node"), F.col("y").alias("grp"))
    if large.isEmpty():
        return out
    rest = e.join(large, "component", "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b"), "o")
    return out.unionByName(in_rounds(n.join(large, "component", "left_semi"), rest, checkpoint, most=most, lasting=lasting))


def cells(groups: DataFrame, e: DataFrame, turn: int) -> DataFrame:
    """(grp, cell): groups with what lies near them. The least of a hash over a group and two steps around it, drawn anew each turn; cells of over MOST_PAIRS pairs are parted."""
    sides = lambda v: v.select(F.col("x").alias("grp"), F.col("y").alias("to")).unionByName(v.select(F.col("y").alias("grp"), F.col("x").alias("to")))
    cell = groups.select("grp", F.xxhash64("grp", F.lit(turn)).alias("cell"))
    for _ in range(2):
        around = sides(e).join(cell.withColumnRenamed("grp", "to"), "to").select("grp", "cell").unionByName(cell)
        cell = around.groupBy("grp").agg(F.min("cell").alias("cell"))
    pairs = sides(e).join(cell, "grp").groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / (2 * MOST_PAIRS))
    return cell.join(pairs, "cell").select("grp", F.xxhash64("cell", F.pmod(F.xxhash64(F.lit("part"), "grp"), parts)).alias("cell"))


def in_rounds(nodes: DataFrame, pairs: DataFrame, checkpoint, *, most_rounds: int = 500, most: int = 0, lasting: bool = False) -> DataFrame:
    """closed() for pairs (a, b, s, h), or what met_once() gave as (a, b, o), of any number; lasting if no third group can end a conflict.

    Each round takes pairs one by one within cells of groups that lie together, as far as no earlier pair leads out of
    the cell, and decides the pairs between cells that come first for both their groups. Rounds end when no pair is
    left, and too many are an error. The last `most` pairs are one cell. A round moves pairs and groups, never texts.
    """
    g = nodes.select(F.col("node").alias("grp"), *STATE)
    if "o" in pairs.columns:
        e = checkpoint(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "o"))
    else:
        e = checkpoint(met_once(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("s", "h", "a", "b").alias("o")), g, lasting=lasting))
    every = pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).distinct()
    member = checkpoint(every.select(F.col("grp").alias("node"), "grp"))
    g = checkpoint(g.join(every, "grp", "left_semi"))
    for turn in range(most_rounds):
        n = e.count()
        if n == 0:
            break
        ends = e.select(F.col("x").alias("grp")).union(e.select("y")).distinct()
        active = g.join(ends, "grp", "left_semi")
        cell = checkpoint(cells(active, e, turn) if n > most else active.select("grp", F.lit(0).cast("long").alias("cell")))
        placed = checkpoint(e.join(cell.withColumnsRenamed({"grp": "x", "cell": "cx"}), "x").join(cell.withColumnsRenamed({"grp": "y", "cell": "cy"}), "y"))
        sides = placed.select(F.col("x").alias("grp"), "o", (F.col("cx") != F.col("cy")).alias("out")).unionByName(placed.select(F.col("y").alias("grp"), "o", (F.col("cx") != F.col("cy")).alias("out")))
        firsts = sides.groupBy("grp").agg(F.min("o").alias("o"), F.min(F.when(F.col("out"), F.col("o"))).alias("till"))
        firsts = checkpoint(firsts)
        inside = dealt(placed.where("cx = cy").withColumnRenamed("cx", "cell"), n, "cell")
        seated = active.join(cell, "grp").join(firsts.select("grp", "till"), "grp").withColumnRenamed("grp", "node")
        taken = checkpoint(in_cells(seated, inside, "cell", lasting=lasting).where("NOT into OR x <> y"))
        both = firsts.groupBy("o").agg(F.count("*").alias("n")).where("n = 2").select("o")
        chosen = placed.where("cx <> cy").join(both, "o", "left_semi")
        state = lambda end, of: g.select(F.col("grp").alias(end), F.struct(*STATE).alias(of))  # noqa: B023, E731
        judged = checkpoint(chosen.join(state("x", "p"), "x").join(state("y", "q"), "y").select("x", "y", conflict("p", "q").alias("no")))
        # at most one row per group, from tables of their own; so the chain of these joins at the end is cheap
        into = taken.where("into").select(F.col("x").alias("old"), F.col("y").alias("new")).unionByName(judged.where("NOT no").select(F.col("y").alias("old"), F.col("x").alias("new")))
        refused = taken.where("NOT into").select("x", "y").unionByName(judged.where("no").select("x", "y"))
        g = checkpoint(grown(moved(g, into, "grp")))
        left = moved(moved(e.join(refused, ["x", "y"], "left_anti"), into, "x"), into, "y")
        e = checkpoint(met_once(left, g, lasting=lasting))
        member = moved(member, into, "grp")
    else:
        raise RuntimeError(f"pairs are left after {most_rounds} rounds")
    return member


def merge(events: DataFrame, checkpoint, *, verdicts: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """(event_id, grp): every event with the least event of its group.

    verdicts (a, b, verdict), where there are some, decide instead of likeness which candidates are pairs: those judged
    same or phase. Events without a company or a root stay alone, as do those without a name.
    """
    e = checkpoint(prepared(events, checkpoint))
    if verdicts is None:
        sigs = checkpoint(signatures(e))
        nodes = sigs.withColumnRenamed("sig", "node")
        if sigs.where(F.size("subjects") > 1).isEmpty():
            groups = by_range(sigs, checkpoint, least=least)
        else:
            groups = closed(nodes, candidates(sigs, least=least, index=checkpoint), checkpoint)
        groups = of_signatures(e, nodes, groups)
    else:
        groups = closed(e.withColumnRenamed("event_id", "node"), judged_pairs(e, verdicts), checkpoint)
    found = groups.withColumnRenamed("node", "event_id")
    return events.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("grp", "event_id").alias("grp"))


def judged_pairs(e: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(a, b, alike): the pairs judged same or phase that have a company and a root in common."""
    said = verdicts.where(F.col("verdict").isin("same", "phase") & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda end: e.select(F.col("event_id").alias(end), F.struct("companies", "roots").alias(f"of_{end}"))
    both = said.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("of_a.companies", "of_b.companies") & F.arrays_overlap("of_a.roots", "of_b.roots"))
    alike = F.size(F.array_intersect("of_a.roots", "of_b.roots")) / F.least(F.size("of_a.roots"), F.size("of_b.roots"))
    return both.select("a", "b", F.round(alike, 3).alias("alike"))


def of_signatures(e: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, grp) of events from that of their signatures: those that agree in all that is compared are one.

    Unless they recur and span a year by themselves, or touch no company: then each stays alone.
    """
    same = ["companies", "subjects", "roots", "low", "high", "recurs"]
    one = (F.size("companies") > 0) & ~(F.col("recurs") & (F.coalesce(F.col("high") - F.col("low"), F.lit(0)) >= MOST_MONTHS))
    sigs = nodes.join(groups, "node", "left").select(F.xxhash64(*same).alias("k"), *[F.col(c).alias(f"s_{c}") for c in same], F.coalesce("grp", "node").alias("grp"))
    found = e.withColumn("k", F.xxhash64(*same)).join(sigs, "k").where(" AND ".join(f"{c} <=> s_{c}" for c in same))
    return found.select(F.col("event_id").alias("node"), F.when(one, F.col("grp")).otherwise(F.col("event_id")).alias("grp"))


def timelines(events: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, keeper, timeline): of each group of two events or more the event with most links, and what all were called, by month.

    events has event_id, name, dates, degree; timeline entries are (at, label, event_id). A group is a handful of events.
    """
    at = F.array_min(F.transform("dates", lambda d: F.substring(d, 1, 7)))
    rows = events.select("event_id", "degree", F.struct(at.alias("at"), F.col("name").alias("label"), "event_id").alias("entry")).join(groups, "event_id")
    one = rows.groupBy("grp").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("degree")).alias("d"), "event_id"))["event_id"].alias("keeper"), F.sort_array(F.collect_list("entry")).alias("timeline"))
    return one.where("n > 1").drop("n")
