"""Tag filters: a small text language compiled to a Column over tags array<struct<k, v>>.

Terms separated by white space are OR-ed: `k=v`, `k=*` or `k` (key exists), `k!=v`, `!k`, `k!=*`. Keys and values may be
quoted; a quoted "*" is the literal. A bare key ends at `=` or `!`, a bare value only at white space. A negated term is true where the key is absent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that can't be read, with the byte offset of the trouble."""

    def __init__(self, offset: int, what: str):
        super().__init__(f"at byte {offset}: {what}")
        self.offset = offset


@dataclass(frozen=True)
class TagFilter:
    """op: tag (key, value), exists (key), all, any or not (parts)."""

    op: str
    key: str = ""
    value: str = ""
    parts: tuple["TagFilter", ...] = ()

    def column(self, tags: Column) -> Column:
        if self.op == "tag":
            return F.coalesce(F.exists(tags, lambda t: (t["k"] == self.key) & (t["v"] == self.value)), F.lit(False))
        if self.op == "exists":
            return F.coalesce(F.exists(tags, lambda t: t["k"] == self.key), F.lit(False))
        if self.op == "not":
            return ~self.parts[0].column(tags)
        both = (lambda a, b: a & b) if self.op == "all" else (lambda a, b: a | b)
        return reduce(both, (p.column(tags) for p in self.parts), F.lit(self.op == "all")) if self.parts else F.lit(self.op == "all")

    def __and__(self, other: "TagFilter") -> "TagFilter":
        return TagFilter("all", parts=(self, other))

    def __or__(self, other: "TagFilter") -> "TagFilter":
        return TagFilter("any", parts=(self, other))

    def __invert__(self) -> "TagFilter":
        return TagFilter("not", parts=(self,))


def _where(text: str, at: int) -> int:
    return len(text[:at].encode())


def _word(text: str, at: int, stops: str = "") -> tuple[str, bool, int]:
    """(word, whether it was quoted, where it ends); a bare word ends at white space and at one of `stops`. In quotes only a quote can be escaped."""
    if text[at : at + 1] == '"':
        quoted = re.compile(r'"((?:\\"|[^"])*)"').match(text, at)
        if not quoted:
            raise FilterError(_where(text, at), "the quote isn't closed")
        return quoted[1].replace('\\"', '"'), True, quoted.end()
    end = next((i for i in range(at, len(text)) if text[i].isspace() or text[i] in stops), len(text))
    if '"' in text[at:end]:
        raise FilterError(_where(text, text.index('"', at)), "a quote inside a bare word")
    return text[at:end], False, end


def _term(text: str, at: int) -> tuple[TagFilter, int]:
    """The term that starts at `at`, and where it ends."""
    negated = text[at] == "!"
    key, _, end = _word(text, at + negated, "=!")
    if not key:
        raise FilterError(_where(text, at), "a key is missing")
    exists, relation = TagFilter("exists", key), next((r for r in ("!=", "=", "!") if text.startswith(r, end)), "")
    if relation and negated:
        raise FilterError(_where(text, end), "a negated key takes no value")
    if relation == "!":
        raise FilterError(_where(text, end + 1), "= is missing after !")
    if not relation:
        return ~exists if negated else exists, end
    value, quoted, last = _word(text, end + len(relation))
    if not value and not quoted:
        raise FilterError(_where(text, last), "a value is missing")
    term = exists if value == "*" and not quoted else TagFilter("tag", key, value)
    return ~term if relation == "!=" else term, last


def parse(text: str) -> TagFilter:
    terms, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        term, at = _term(text, at)
        if at < len(text) and not text[at].isspace():
            raise FilterError(_where(text, at), "a space is missing")
        terms.append(term)
    if not terms:
        raise FilterError(0, "the filter is empty")
    return terms[0] if len(terms) == 1 else TagFilter("any", parts=tuple(terms))


# The keys that curated output keeps.
CURATED_KEYS = (
    "highway", "building", "waterway", "water", "natural", "landuse", "railway", "amenity", "leisure", "boundary", "place", "shop", "tourism", "office", "healthcare", "craft", "historic", "club", "emergency", "education",
    "name", "ref", "admin_level", "addr:street", "addr:housenumber", "addr:city", "addr:postcode", "phone", "contact:phone", "website", "contact:website", "opening_hours", "cuisine", "brand", "operator", "description",
)


def retained(tags: Column, keys: list[str] | str) -> Column:
    """The tags with one of `keys`, in their order; "all" keeps every tag, "curated" those of CURATED_KEYS."""
    if keys == "all":
        return tags
    held = CURATED_KEYS if keys == "curated" else tuple(keys)
    return F.filter(tags, lambda t: t["k"].isin(*held)) if held else F.slice(tags, 1, 0)


def first_value(tags: Column, key: str) -> Column:
    """Of duplicate keys the first counts."""
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def last_non_empty(tags: Column, key: str) -> Column:
    """Of duplicate keys the last with a value counts."""
    return F.try_element_at(F.filter(tags, lambda t: (t["k"] == key) & (t["v"] != "")), F.lit(-1))["v"]
