"""Text functions as column expressions: they stay in the JVM."""

from __future__ import annotations

import operator
import os
import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon

LEFT, RIGHT = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"


def content_hash(text: Column) -> Column:
    """Hex SHA-256 of the text in lower case with white space runs made one space; equal for texts that differ in these only."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def keyword_hits(text: Column, keywords: Iterable[str]) -> Column:
    """The keywords that the text contains in any letter case, in the order given."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, keywords)).cast("array<string>"), lambda k: F.contains(low, F.lower(k)))


def _java(needle: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", needle)


def _same(char: str) -> str:
    """One for all characters that Java's engine takes to be the same but for letter case."""
    for to in (char.upper(), char.lower()):
        char = to if len(to) == 1 else char
    return {"\u0130": "i"}.get(char, char)


def _branches(needles: Iterable[str]) -> str:
    """The needles as a tree of their characters, of which a text's next one leaves one branch at most; the longest is tried first."""
    heads: dict[str, list[str]] = {}
    for n in needles:
        if n:
            heads.setdefault(n[0], []).append(n[1:])
    ends, parts = len(heads) and "" in needles, []
    for head, rest in sorted(heads.items()):
        shared = os.path.commonprefix(rest)
        parts.append(_java(head + shared) + _branches({r[len(shared) :] for r in rest}))
    if len(parts) > 1 or ends:
        return f"(?:{'|'.join(parts)}){'?' if ends else ''}"
    return "".join(parts)


def alternation(needles: Iterable[str]) -> str:
    """The longest of those that a place has, so that a scan from the left keeps the longest name of those that overlap."""
    return f"(?iu){LEFT}({_branches({''.join(map(_same, n)) for n in needles})}){RIGHT}"


def mentions(text: Column, names: Mapping[str, str]) -> Column:
    """The normalised name of each mention, leftmost and longest; every needle maps to its name."""
    found = F.regexp_extract_all(text, F.lit(alternation(names)), F.lit(1))
    changed = {k.lower(): v for k, v in names.items() if k.lower() != v}
    table = F.create_map(*(F.lit(x) for kv in changed.items() for x in kv)) if changed else None
    if table is None:
        return F.transform(found, lambda x: F.lower(x))
    return F.transform(found, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.lower(x)))


DRUG_NAMES = {**{g: g for g in lexicon.GENERIC_DRUGS}, **lexicon.BRAND_TO_GENERIC}
SYMPTOM_NAMES = {s: s for s in lexicon.SYMPTOMS}


def drugs(text: Column) -> Column:
    return mentions(text, DRUG_NAMES)


def symptoms(text: Column, canonical: bool = False) -> Column:
    """As written by default; canonical maps synonyms to one name."""
    return mentions(text, lexicon.SYNONYM_TO_CANONICAL | {s: lexicon.SYNONYM_TO_CANONICAL.get(s, s) for s in lexicon.SYMPTOMS} if canonical else SYMPTOM_NAMES)


def has_mention(text: Column, names: Iterable[str]) -> Column:
    return text.rlike(alternation(names))


def has_trigger(text: Column) -> Column:
    """In any letter case; a pattern is tried only in texts that hold its first letters."""
    found = lambda low: reduce(operator.or_, ((F.contains(low, F.lit(held)) if held else F.lit(True)) & low.rlike("(?U)" + p) for held, p in lexicon.trigger_starts()))
    return F.element_at(F.transform(F.array(F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))), found), 1)


def pairs(a: Column, b: Column) -> Column:
    """Each distinct combination of two arrays, of one record. b is bound first: in a lambda it would be computed for each element of a."""
    combined = lambda y: F.flatten(F.transform(F.array_distinct(a), lambda d: F.transform(y, lambda e: F.struct(d.alias("drug"), e.alias("event")))))
    return F.element_at(F.transform(F.array(F.array_distinct(b)), combined), 1)


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """Occurrences of each term between other characters than a-z, of the text in lower case, summed; terms that overlap each count."""
    low, total = F.lower(text), F.lit(0)
    for t in terms:
        total = total + F.regexp_count(low, F.lit(f"(?<![a-z]){_java(t.lower())}(?![a-z])"))
    return total


def pii_pattern(kind: str) -> str:
    """The pattern for Java's engine, with Unicode classes."""
    pattern, ignore = next((p, i) for k, p, _, i in lexicon.PII_PATTERNS if k == kind)
    return f"(?{'i' if ignore else ''}uU){pattern}"


def count_pii(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(pii_pattern(kind)))


def redact_kind(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, pii_pattern(kind), f"<{kind}>")


def relevant(text: Column, connector: Column, keywords: Iterable[str]) -> Column:
    """Kept by ingestion: from a curated connector, or with a keyword, a drug or a symptom."""
    curated = connector.isin(*[k for k, v in lexicon.CONNECTORS.items() if v in lexicon.TRUSTED])
    return curated | (F.size(keyword_hits(text, keywords)) > 0) | has_mention(text, [*DRUG_NAMES, *SYMPTOM_NAMES])


def highlight(text: Column, drug: Column, event: Column, length: int = 280) -> Column:
    """The first characters with the drug hidden and the event marked."""
    quoted = lambda c: F.concat(F.lit(r"(?iu)\Q"), c, F.lit(r"\E"))
    short = F.substring(text, 1, length)
    return F.regexp_replace(F.regexp_replace(short, quoted(drug), F.lit("<REDACTED_DRUG>")), quoted(event), F.lit("<u>$0</u>"))
