"""Names, addresses, ids and output formats as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tagfilter import first_value

ADDRESS_TAIL = ("addr:city", "addr:state", "addr:postcode")
# Keys of contact fields, keys and prefixes left out of the tag line, and keys that say what a place is.
PHONE_KEYS = ("phone", "contact:phone", "telephone")
WEBSITE_KEYS = ("website", "contact:website", "url")
SKIPPED_KEYS = ("name", "phone", "telephone", "website", "url", "operator")
SKIPPED_PREFIXES = ("addr:", "contact:")
CATEGORY_KEYS = ("amenity", "craft", "healthcare", "leisure", "office", "shop", "tourism")


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def address(tags: Column) -> Column:
    """'{number} {street}, city, state, postcode' of what is there; a number without a street is left out."""
    get = lambda k: non_empty(first_value(tags, k))
    street = F.when(get("addr:street").isNotNull(), F.concat_ws(" ", get("addr:housenumber"), get("addr:street")))
    return F.concat_ws(", ", street, *[get(k) for k in ADDRESS_TAIL])


def first_of(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[non_empty(first_value(tags, k)) for k in keys])


def address_parts(tags: Column) -> Column:
    """map of addr_* to value from the tags addr:*; of duplicates the last non-empty counts."""
    own = F.filter(tags, lambda t: t["k"].startswith("addr:") & (t["v"] != ""))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.aggregate(own, empty, lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != F.replace(t["k"], F.lit(":"), F.lit("_"))), F.create_map(F.replace(t["k"], F.lit(":"), F.lit("_")), t["v"])))


def tag_line(tags: Column, skipped: tuple[str, ...] = SKIPPED_KEYS, prefixes: tuple[str, ...] = SKIPPED_PREFIXES) -> Column:
    """'k=v; k=v' in key order, without some keys and prefixes."""
    keep = F.filter(tags, lambda t: ~t["k"].isin(list(skipped) or [""]) & ~F.coalesce(t["k"].rlike("^(" + "|".join(prefixes) + ")"), F.lit(False))) if prefixes else F.filter(tags, lambda t: ~t["k"].isin(list(skipped) or [""]))
    return F.array_join(F.array_sort(F.transform(keep, lambda t: F.concat(t["k"], F.lit("="), t["v"]))), "; ")


def csv_safe(c: Column) -> Column:
    """A leading formula character gets a quote in front."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def degrees7(c: Column) -> Column:
    return F.format_string("%.7f", c / 1e7)


def sequence_path(seq: Column) -> Column:
    return F.format_string("%03d/%03d/%03d", F.floor(seq / 1000000), F.floor(seq / 1000) % 1000, seq % 1000)


def osm_name(osm_type: Column, id_: Column) -> Column:
    return F.concat(F.when(osm_type == 1, "node").when(osm_type == 2, "way").otherwise("relation"), F.lit("/"), id_)


def osm_short(osm_type: Column, id_: Column) -> Column:
    """n1, w1 or r1."""
    return F.concat(F.when(osm_type == 1, "n").when(osm_type == 2, "w").otherwise("r"), id_.cast("string"))


def next_diff_url(base: Column, seq: Column) -> Column:
    """Where the diff after a sequence is published."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), sequence_path(seq + 1), F.lit(".osc.gz"))


def tag_pairs(line: Column) -> Column:
    """array<struct<k, v>> of a tag line: cut at "; ", then at the first "="; a piece without one is left out."""
    pieces = F.filter(F.split(line, "; "), lambda p: p.contains("="))
    return F.transform(pieces, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))


def fold_name(name: str) -> str:
    """A name for comparison: case and compatibility folded, the dot above i and j dropped, white space collapsed."""
    n = unicodedata.normalize
    s = n("NFKD", n("NFD", name).casefold()).casefold()
    kept = []
    for c in s:
        if c == "̇" and kept and kept[-1] in "ij":
            continue
        kept.append(c)
    return " ".join(n("NFKC", "".join(kept)).split())


def normalize_name(c: Column | str) -> Column:
    """fold_name by Arrow batches."""

    def fold(names: pd.Series) -> pd.Series:
        return names.map(fold_name, na_action="ignore")

    return F.pandas_udf(fold, "string", functionType=F.PandasUDFType.SCALAR)(c)
