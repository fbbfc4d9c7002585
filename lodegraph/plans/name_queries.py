"""Names of a dictionary in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary
from ..sources import graph as G
from .registry import query


def named_texts(spark, d):
    """Every order's note, which speaks of its customer and of a part, with particles behind and other words around."""
    o = G.table(spark, d, "orders")
    text = "o_orderpriority || ' Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || CASE o_orderkey % 4 WHEN 0 THEN '는 ' WHEN 1 THEN '에서 ' WHEN 2 THEN 's ' ELSE ', ' END || substr('Clerk of the day', 1, CAST(o_orderkey % 15 AS INT)) || ' Customer#' || lpad(CAST(o_custkey + 7 AS STRING), 9, '0') || '이'"
    return o.selectExpr("o_orderkey AS ident", f"{text} AS text")


def dictionary_names(spark, d):
    """Every customer's name, and the names without their last digit, which stand within others."""
    c = G.table(spark, d, "customer")
    return c.selectExpr("CAST(c_custkey AS STRING) AS code", "c_name AS name").unionByName(c.selectExpr("'p' || CAST(c_custkey AS STRING) AS code", "substr(c_name, 1, length(c_name) - 1) AS name").where("code LIKE '%3'"))


_TEXTS = "(SELECT o_orderkey AS ident, o_orderpriority || ' Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || CASE o_orderkey % 4 WHEN 0 THEN '는 ' WHEN 1 THEN '에서 ' WHEN 2 THEN 's ' ELSE ', ' END || substr('Clerk of the day', 1, CAST(o_orderkey % 15 AS INT)) || ' Customer#' || lpad(CAST(o_custkey + 7 AS VARCHAR), 9, '0') || '이' AS text FROM orders)"
_NAMES = "(SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name FROM customer UNION ALL SELECT 'p' || c_custkey, substr(c_name, 1, length(c_name) - 1) FROM customer WHERE c_custkey % 10 = 3)"
# Every name begins with the same sign, so in SQL the places are those of that sign, and names are compared there.
_PLACES = f"places AS (SELECT ident, text, i AS start FROM (SELECT ident, text, unnest(range(1, length(text) + 1)) AS i FROM {_TEXTS}) WHERE substr(text, i, 9) = 'Customer#')"
_FOUND = f"{_PLACES}, found AS (SELECT ident, start, length(name) AS len, code, name, text FROM places JOIN {_NAMES} ON name = substr(text, start, 18) OR name = substr(text, start, 17))"


@query(f"WITH {_FOUND} SELECT ident, start, len, code FROM found", with_graph=False)
def name_mentions(spark, d):
    return dictionary.occurrences(named_texts(spark, d), dictionary_names(spark, d)).select("ident", "start", "len", "code")


@query(f"WITH {_FOUND}, w AS (SELECT *, regexp_extract(substr(text, start + len), '^[\\pL\\pN]*') AS after, substr(text, start - 1, 1) AS previous FROM found) SELECT ident, start, code FROM w WHERE (after IN ('', '으로부터','에서는','에서도','에게서','으로는','이라는','에서','에게','으로','까지','부터','처럼','보다','마다','라는','에는','에도','와의','과의','이나','에','의','은','는','이','가','을','를','와','과','도','로','만')) AND (start = 1 OR NOT regexp_matches(previous, '[\\pL\\pN]'))", with_graph=False)
def name_words(spark, d):
    return dictionary.whole_words(dictionary.occurrences(named_texts(spark, d), dictionary_names(spark, d))).select("ident", "start", "code")


@query(f"WITH {_FOUND} SELECT ident, start, len, code FROM found QUALIFY row_number() OVER (PARTITION BY ident, start ORDER BY len DESC, code) = 1", with_graph=False)
def name_longest(spark, d):
    """Names here begin alike, so none lies over the middle of another; tests have such ones."""
    return dictionary.longest(dictionary.occurrences(named_texts(spark, d), dictionary_names(spark, d))).select("ident", "start", "len", F.col("code"))
