"""Names of products, and splits of events that are undone; the SQL writes out every fixed word by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import products as P
from ..operators import reports, splits
from ..sources import graph as G
from .record_queries import Rows
from .registry import query

NAMES = Rows(
    "part",
    (
        "p_partkey AS key", "p_partkey % 17 AS degree",
        "CASE p_partkey % 23 WHEN 0 THEN '고대역폭메모리(HBM)' WHEN 1 THEN '열압착(TC) 본더' WHEN 2 THEN '열압착장비(TC본더)' WHEN 3 THEN '서버 D램' WHEN 4 THEN 'NAND Flash' WHEN 5 THEN '비메모리' WHEN 6 THEN 'HBM4' WHEN 7 THEN ' 디램 ' WHEN 8 THEN '전력반도체 (SiC)' WHEN 9 THEN '차량용 반도체(mcu )' WHEN 10 THEN 'SSD (Bravo)' WHEN 11 THEN '램(AP)' WHEN 12 THEN 'TC 본더 4.5' WHEN 13 THEN 'AI 연산에 필수적인 HBM' WHEN 14 THEN 'cobot' WHEN 15 THEN '서버 DRAM' WHEN 16 THEN '산업용 낸드 모듈' WHEN 17 THEN '' WHEN 19 THEN 'EUV 노광장비' WHEN 20 THEN '질화갈륨(Gan)' WHEN 21 THEN '(HBM)' WHEN 22 THEN 'Humanoid Robot' END || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_name ELSE '' END AS name",
    ),
)
_WHOLE = "HBM:hbm,고대역폭메모리,고대역폭메모리hbm,highbandwidthmemory|DRAM:dram,d램,디램,dynamicrandomaccessmemory|낸드플래시:nand,nandflash,낸드,낸드플래시,낸드플레시|TC 본더:tc본더,tcb,tcb장비,열압착tc본더,열압착장비tc본더,열압착본더|하이브리드 본더:하이브리드본더,hybridbonder|EUV 장비:euv,euv장비,euv노광장비,extremeultraviolet|실리콘 웨이퍼:실리콘웨이퍼,siliconwafer|eSSD:essd,기업용ssd,enterprisessd|메모리반도체:메모리반도체,memorysemiconductor|파운드리:파운드리,foundry|협동로봇:협동로봇,cobot,collaborativerobot|휴머노이드 로봇:휴머노이드로봇,humanoid,humanoidrobot"
_key = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^0-9a-z가-힣]', '', 'g')"
_CANONICAL = f"""
whole AS (SELECT split_part(x, ':', 1) AS product, unnest(string_split(split_part(x, ':', 2), ',')) AS k FROM (SELECT unnest(string_split('{_WHOLE}', '|')) AS x)),
word(k, product) AS (VALUES ('d램', 'DRAM'), ('디램', 'DRAM'), ('dram', 'DRAM'), ('낸드', '낸드플래시'), ('nand', '낸드플래시'), ('tc본더', 'TC 본더'), ('hbm', 'HBM')),
n AS (SELECT key, degree, name, trim(coalesce(name, '')) AS raw FROM {NAMES.sql}),
b AS (SELECT *, trim(regexp_extract(raw, '[（(]\\s*([^)）]{{1,12}})\\s*[)）]\\s*$', 1)) AS inside, {_key("regexp_extract(raw, '^[^（(]*')")} AS before FROM n),
s AS (SELECT b.*, CASE WHEN upper(inside) IN ('HBM','DRAM','NAND','SSD','EUV','TC','TCB','AP','MCU','SIC','GAN','CIS','LPDDR','GDDR','DDR') AND before <> '' AND (length(before) >= 3 OR before IN (SELECT k FROM whole)) THEN CASE WHEN inside = upper(inside) OR inside = lower(inside) THEN upper(inside) ELSE inside END END AS short FROM b),
p AS (SELECT key, i, w, {_key("w")} AS k FROM (SELECT key, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT key, [x for x in string_split_regex(raw, '\\s+') if x <> ''] AS l FROM s))),
r AS (SELECT key, count(*) AS words, string_agg(CASE WHEN product IS NOT NULL AND p.k <> {_key("product")} THEN product ELSE w END, ' ' ORDER BY i) AS renamed, string_agg(w, ' ' ORDER BY i) AS plain FROM p LEFT JOIN word USING (k) GROUP BY key),
canonical AS (
    SELECT s.key, s.degree, s.name, CASE WHEN short IS NOT NULL THEN coalesce(a.product, short) WHEN f.product IS NOT NULL THEN f.product WHEN words > 1 AND renamed <> plain THEN renamed ELSE raw END AS product
    FROM s LEFT JOIN whole a ON a.k = {_key("short")} LEFT JOIN whole f ON f.k = {_key("raw")} LEFT JOIN r ON r.key = s.key)
"""


@query(f"WITH {_CANONICAL} SELECT key, product, {_key('product')} AS norm, regexp_matches(trim(coalesce(name, '')), '필수적인|위한|관련된|사용되는|불리는|이라고|등의|같은') OR length(trim(coalesce(name, ''))) > 40 AS describes FROM canonical", with_graph=False)
def product_names(spark, d):
    n = NAMES.df(spark, d)
    return n.select("key", P.canonical_product(F.col("name")).alias("product"), P.canonical_key(F.col("name")).alias("norm"), P.describes(F.col("name")).alias("describes"))


@query(f"WITH {_CANONICAL}, k AS (SELECT key, degree, {_key('product')} AS k FROM canonical), g AS (SELECT k, arg_min(key, struct_pack(d := -degree, key := key)) AS keep FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1) SELECT key AS old, keep FROM k JOIN g USING (k) WHERE key <> keep", with_graph=False)
def product_merge(spark, d):
    return reports.product_keepers(NAMES.df(spark, d), by=P.canonical_key)


EDGES = Rows("events", ("CAST(event_id AS STRING) AS edge_id", "'E' || CAST(user_id % 90 AS STRING) AS event_id", "'d' || CAST(event_id % 11 AS STRING) AS doc", "CASE WHEN event_id % 9 > 0 THEN CAST(2021 + event_id % 11 % 4 AS STRING) || '-' || CAST(10 + event_id % 3 AS STRING) END AS occurred_at"))


def _log(spark, d):
    e = EDGES.df(spark, d)
    number = F.substring("event_id", 2, 9).cast("int")
    ids = e.select("event_id").distinct()
    first = ids.where(number % 3 == 0).select("event_id", F.concat("event_id", F.lit("a")).alias("new_id"), F.array(*map(F.lit, ("d1", "d4", "d7"))).alias("docs"))
    log1 = splits.moves(e, first, 1)
    then = splits.state(e, log1)
    second = then.select("event_id").distinct().where("event_id LIKE '%a' AND CAST(substr(event_id, 2, length(event_id) - 2) AS INT) % 2 = 0")
    second = second.select("event_id", F.concat("event_id", F.lit("b")).alias("new_id"), F.array(*map(F.lit, ("d4", "d7"))).alias("docs"))
    return e, log1.unionByName(splits.moves(then, second, 2))


_E = f"e AS (SELECT *, CAST(substr(event_id, 2) AS INT) AS n FROM {EDGES.sql}), m AS (SELECT *, n % 3 = 0 AND doc IN ('d1', 'd4', 'd7') AS one, n % 6 = 0 AND doc IN ('d4', 'd7') AS two FROM e)"


@query(f"WITH {_E} SELECT edge_id, CASE WHEN two THEN event_id || 'ab' WHEN one THEN event_id || 'a' ELSE event_id END AS event_id, CASE WHEN one THEN event_id || 'a' ELSE event_id END AS after_first, CASE WHEN two THEN event_id || 'ab' ELSE event_id END AS without_first, event_id AS rolled_back FROM m", with_graph=False)
def split_states(spark, d):
    """Every edge after both changes, after the first, with the first undone, and after both inverses."""
    e, log = _log(spark, d)
    undone = spark.range(1).select(F.lit(1).cast("long").alias("change"))
    whole = log.unionByName(splits.inverse(log, 2))
    at = lambda name, df: df.select("edge_id", F.col("event_id").alias(name))
    out = splits.state(e, log).select("edge_id", "event_id")
    for name, df in (("after_first", splits.state(e, log, as_of=1)), ("without_first", splits.state(e, log, undone=undone)), ("rolled_back", splits.state(e, whole))):
        out = out.join(at(name, df), "edge_id")
    return out


_PHASES = "['2020-01|가|x', '2021-10|나|x', '2022-11|다|x', '2024-12|라|x', '2029-01|마|x', '미상|바|x', '2023-12|사|x']"


@query(
    f"""WITH {_E}, s AS (SELECT CASE WHEN two THEN event_id || 'ab' WHEN one THEN event_id || 'a' ELSE event_id END AS id, event_id AS orig, occurred_at FROM m),
    span AS (SELECT id, min(CAST(substr(occurred_at, 1, 4) AS INT) * 12 + CAST(substr(occurred_at, 6, 2) AS INT)) AS lo, max(CAST(substr(occurred_at, 1, 4) AS INT) * 12 + CAST(substr(occurred_at, 6, 2) AS INT)) AS hi FROM s WHERE occurred_at IS NOT NULL GROUP BY id),
    fam AS (SELECT DISTINCT orig, id FROM s WHERE orig IN (SELECT orig FROM s WHERE id <> orig)),
    ent AS (SELECT orig, entry, pos, TRY_CAST(substr(entry, 1, 4) AS INT) * 12 + TRY_CAST(substr(entry, 6, 2) AS INT) AS mo FROM (SELECT DISTINCT orig FROM fam), (SELECT unnest({_PHASES}) AS entry, generate_subscripts({_PHASES}, 1) AS pos)),
    best AS (SELECT orig, entry, pos, id, greatest(lo - mo, mo - hi, 0) AS far FROM ent JOIN fam USING (orig) JOIN span USING (id) WHERE mo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY orig, pos ORDER BY far, id <> orig, id) = 1)
    SELECT f.id AS event_id, concat_ws(';', '2030-01|새|y', string_agg(entry, ';' ORDER BY pos)) AS timeline FROM fam f LEFT JOIN best b ON f.id = b.id AND f.orig = b.orig AND far <= 12 GROUP BY f.id""",
    with_graph=False,
)
def split_phases(spark, d):
    e, log = _log(spark, d)
    now = splits.state(e, log)
    moved = log.join(e.select("edge_id", F.col("event_id").alias("orig_id")), "edge_id").join(now.select("edge_id", F.col("event_id").alias("new_id")), "edge_id")
    phases = F.expr("array('2020-01|가|x', '2021-10|나|x', '2022-11|다|x', '2024-12|라|x', '2029-01|마|x', '미상|바|x', '2023-12|사|x')")
    parts = moved.select("orig_id", "new_id").distinct().withColumn("orig_timeline", phases)
    events = now.select("event_id").distinct().withColumn("timeline", F.array(F.lit("2030-01|새|y"), F.lit("2021-10|나|x")))
    return splits.dealt_phases(events, parts, now).select("event_id", F.array_join("timeline", ";").alias("timeline"))
