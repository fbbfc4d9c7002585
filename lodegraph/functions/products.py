"""Names of products in three layers: abbreviations in brackets, whole names, single words. Never parts of words.

A name of another generation or kind is another product: HBM4 is no HBM, and what ends in a known word is not that word.
So only whole names and whole words between spaces are replaced, and what is not known stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Products by all keys under which their whole name is known.
WHOLE = {
    "HBM": ("hbm", "고대역폭메모리", "고대역폭메모리hbm", "highbandwidthmemory"),
    "DRAM": ("dram", "d램", "디램", "dynamicrandomaccessmemory"),
    "낸드플래시": ("nand", "nandflash", "낸드", "낸드플래시", "낸드플레시"),
    "TC 본더": ("tc본더", "tcb", "tcb장비", "열압착tc본더", "열압착장비tc본더", "열압착본더"),
    "하이브리드 본더": ("하이브리드본더", "hybridbonder"),
    "EUV 장비": ("euv", "euv장비", "euv노광장비", "extremeultraviolet"),
    "실리콘 웨이퍼": ("실리콘웨이퍼", "siliconwafer"),
    "eSSD": ("essd", "기업용ssd", "enterprisessd"),
    "메모리반도체": ("메모리반도체", "memorysemiconductor"),
    "파운드리": ("파운드리", "foundry"),
    "협동로봇": ("협동로봇", "cobot", "collaborativerobot"),
    "휴머노이드 로봇": ("휴머노이드로봇", "humanoid", "humanoidrobot"),
}
#: Single words, the abbreviations that count in brackets, and what shows that a name describes.
WORDS = {"d램": "DRAM", "디램": "DRAM", "dram": "DRAM", "낸드": "낸드플래시", "nand": "낸드플래시", "tc본더": "TC 본더", "hbm": "HBM"}
ABBREVIATIONS = ("HBM", "DRAM", "NAND", "SSD", "EUV", "TC", "TCB", "AP", "MCU", "SiC", "GaN", "CIS", "LPDDR", "GDDR", "DDR")
DESCRIBING = "필수적인|위한|관련된|사용되는|불리는|이라고|등의|같은"
LONGEST = 40
#: A bracket that ends a name.
BRACKET = r"[（(]\s*([^)）]{1,12})\s*[)）]\s*$"


def product_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z가-힣]", "")


def _known(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def canonical_product(c: Column) -> Column:
    """The name that a product goes by; a name that no layer knows stays, white space around it aside. Null counts as empty."""
    whole = _known((key, name) for name, keys in WHOLE.items() for key in keys)
    known = lambda k: F.try_element_at(whole, k)
    raw = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    inside = F.trim(F.regexp_extract(raw, BRACKET, 1))
    before = product_key(F.regexp_extract(raw, r"^([^（(]*)", 1))
    full = (before != "") & (known(before).isNotNull() | (F.length(before) >= 3))
    short = F.when(F.upper(inside).isin(*map(str.upper, ABBREVIATIONS)) & full, F.when((inside == F.upper(inside)) | (inside == F.lower(inside)), F.upper(inside)).otherwise(inside))
    words = _known(WORDS.items())
    one = lambda w: F.try_element_at(words, product_key(w))
    parts = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    renamed = F.transform(parts, lambda w: F.when(one(w).isNotNull() & (product_key(w) != product_key(one(w))), one(w)).otherwise(w))
    by_word = F.when((F.size(parts) > 1) & (F.array_join(renamed, " ") != F.array_join(parts, " ")), F.array_join(renamed, " "))
    return F.when(short.isNotNull(), F.coalesce(known(product_key(short)), short)).otherwise(F.coalesce(known(product_key(raw)), by_word, raw))


def canonical_key(c: Column) -> Column:
    """The key under which names of one product meet."""
    return product_key(canonical_product(c))


def describes(c: Column) -> Column:
    """Whether a name is rather a description: it should be looked at, not merged."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    return raw.rlike(DESCRIBING) | (F.length(raw) > LONGEST)
