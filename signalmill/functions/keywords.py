"""Keyword expansion: configuration-sized, so on the driver; with the provenance of every term."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterable

from .. import lexicon
from .extract import fuzzy

# How sure a term is, by where it comes from.
CONFIDENCE = {"user": 1.0, "dict": 0.85, "fuzzy_morph": 0.55, "fuzzy_lexical": 0.65, "llm": 0.70}


def variants(keyword: str) -> list[str]:
    """The keyword, its canonical symptom and all synonyms of that, a brand's generic, a generic's brands."""
    low = keyword.strip().lower()
    if not low:
        return []
    canonical = lexicon.SYNONYM_TO_CANONICAL.get(low)
    brands = [b for b, g in lexicon.BRAND_TO_GENERIC.items() if g == low]
    return [keyword, *([canonical, *lexicon.SYMPTOM_SYNONYMS[canonical]] if canonical else []), *([lexicon.BRAND_TO_GENERIC[low]] if low in lexicon.BRAND_TO_GENERIC else []), *brands]


def first_wins(terms: Iterable[str]) -> list[str]:
    out: dict[str, str] = {}
    for t in terms:
        if t.strip():
            out.setdefault(t.strip().lower(), t.strip())
    return list(out.values())


def expand(keywords: Iterable[str]) -> list[str]:
    return first_wins(v for k in keywords for v in variants(k))


def morphological(term: str) -> list[str]:
    low = term.lower()
    out = [low.replace(a, b) for a, b in lexicon.MORPH_RULES if a in low]
    out += [low[:-3], f"{low[:-3]}ed"] if low.endswith("ing") else []
    out += [low[:-1]] if low.endswith("s") and len(low) > 3 else []
    return [v for v in dict.fromkeys(out) if v != low]


class TermCache:
    """Answers of a language model by back-end and term, in a JSON file."""

    def __init__(self, path: str):
        self.path = path
        self.held: dict[str, list[str]] = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.held = json.load(f)

    def get(self, backend: str, term: str, ask: Callable[[str], list[str]]) -> list[str]:
        key = f"{backend}:{term.lower()}"
        if key not in self.held:
            self.held[key] = [t.strip() for t in ask(term) if isinstance(t, str) and t.strip()]
            with open(self.path, "w", encoding="utf-8") as f:
                json.dump(self.held, f, ensure_ascii=False, indent=2)
        return self.held[key]


def expand_layered(keywords: Iterable[str], ask: Callable[[str], list[str]] | None = None) -> tuple[list[str], list[tuple[str, str, str, float]]]:
    """(terms, provenance rows of keyword, term, source, confidence). Layers in turn: dictionary, spelling variants, near names,
    and `ask` if given. A term belongs to the first keyword and layer that has it."""
    seen: set[str] = set()
    terms, rows = [], []
    for keyword in keywords:
        layers = [("user" if t.lower() == keyword.lower() else "dict", t) for t in expand([keyword])]
        layers += [("fuzzy_morph", t) for t in morphological(keyword) if len(t) > 2]
        layers += [("fuzzy_lexical", t) for t in fuzzy(keyword)]
        layers += [("llm", t) for t in (ask(keyword) if ask else [])]
        for source, term in layers:
            if term.lower() not in seen:
                seen.add(term.lower())
                terms.append(term)
                rows.append((keyword, term, source, CONFIDENCE[source]))
    return terms, rows


_PROMPT = "List other words that patients write for the medical term {term!r}, misspellings and mixed Hindi and English included. Answer with a JSON list of strings and nothing else."


def server_terms(url: str, model: str, most: int = 10, timeout: float = 20) -> Callable[[str], list[str]]:
    """An `ask` by a server that generates text: it is sent {model, prompt, stream: false} and answers {response: text}, in which the first JSON
    list is looked for. No terms where it can't be asked or says nothing of use."""

    def ask(term: str) -> list[str]:
        body = json.dumps({"model": model, "prompt": _PROMPT.format(term=term), "stream": False}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                said = json.loads(r.read()).get("response") or ""
            found = json.loads(said[said.index("[") : said.rindex("]") + 1])
        except (OSError, ValueError, AttributeError):
            return []
        return [t.strip() for t in found if isinstance(t, str) and t.strip()][:most]

    return ask
