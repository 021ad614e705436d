"""Exact spans, personal data and negation-aware sentiment: Arrow-batched, where no built-in gives all positions."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon, schemas
from . import names

BRAND, GENERIC, SYMPTOM, MODEL = 0.90, 0.85, 0.80, 0.75
NEGATION_TOKENS, NEGATION_CHARS = 5, 60


@cache
def _needles(kind: str) -> names.NameTrie:
    return names.NameTrie((*lexicon.BRAND_TO_GENERIC, *lexicon.GENERIC_DRUGS) if kind == "drug" else lexicon.SYMPTOMS)


@cache
def _triggers() -> tuple:
    return tuple((held, re.compile(p)) for held, p in lexicon.trigger_starts())


def triggered(text: str) -> bool:
    """As a search for any trigger in any letter case; a pattern is tried only where its first letters are."""
    low = names.plain(text).lower()
    return any(p.search(low) for held, p in _triggers() if held in low)


@cache
def _pii() -> tuple:
    return tuple((k, re.compile(p, re.I if ignore else 0), c) for k, p, c, ignore in lexicon.PII_PATTERNS)


@cache
def _address() -> tuple:
    return re.compile(lexicon.ADDRESS[1], re.I), re.compile(lexicon.SIX_DIGITS)


def entities(text: str | None, model=None) -> dict:
    """Drugs and symptoms leftmost-longest with spans, events (symptoms again, if a trigger is there), and drug-event pairs. model: a
    function from a text to further (DRUG or SYMPTOM, start, end, name), as of a trained pipeline; those that overlap no name of
    the lists count too."""
    text = text or ""
    drugs, symptoms = [], []
    for a, b in _needles("drug").find(text):
        name = text[a:b].lower()
        brand = lexicon.BRAND_TO_GENERIC.get(name)
        drugs.append({"type": "DRUG", "text": text[a:b], "start": a, "end": b, "normalized": brand or name, "confidence": BRAND if brand else GENERIC})
    for a, b in _needles("symptom").find(text):
        symptoms.append({"type": "SYMPTOM", "text": text[a:b], "start": a, "end": b, "normalized": text[a:b].lower(), "confidence": SYMPTOM})
    for kind, start, end, name in model(text) if model and text else ():
        if kind in ("DRUG", "SYMPTOM") and all(end <= e["start"] or start >= e["end"] for e in drugs + symptoms):
            (drugs if kind == "DRUG" else symptoms).append({"type": kind, "text": text[start:end], "start": start, "end": end, "normalized": name.lower(), "confidence": MODEL})
    trigger = triggered(text)
    events = [{**s, "type": "ADR_EVENT", "confidence": min(0.85, s["confidence"] + 0.05)} for s in symptoms] if trigger and drugs else []
    found = dict.fromkeys((d["normalized"], s["normalized"]) for d in drugs for s in symptoms)
    return {"entities": drugs + symptoms + events, "pairs": [{"drug": d, "event": e} for d, e in found], "trigger": trigger}


def pairs(text: str | None) -> list[dict]:
    """The drug-event pairs of entities(), without the rest."""
    text = text or ""
    drugs = dict.fromkeys(text[a:b].lower() for a, b in _needles("drug").find(text))
    symptoms = dict.fromkeys(text[a:b].lower() for a, b in _needles("symptom").find(text)) if drugs else {}
    found = dict.fromkeys((lexicon.BRAND_TO_GENERIC.get(d) or d, s) for d in drugs for s in symptoms)
    return [{"drug": d, "event": e} for d, e in found]


def spacy_model(name: str = "en_core_sci_sm"):
    """A model for entities() by a spaCy pipeline, or None where that isn't installed."""
    try:
        import spacy

        pipeline = spacy.load(name)
    except (ImportError, OSError):
        return None
    kinds = {"CHEMICAL": "DRUG", "DRUG": "DRUG", "DISEASE": "SYMPTOM", "SYMPTOM": "SYMPTOM"}
    return lambda text: [(kinds[e.label_], e.start_char, e.end_char, e.text) for e in pipeline(text).ents if e.label_ in kinds]


@dataclass(frozen=True)
class Model:
    """A trained model by name: load() gives a function for entities(), or None where it can't be had here."""

    name: str
    load: Callable[[], Callable | None]


def named_model(name: str | None) -> Model | None:
    """By a source's setting: the name of a spaCy pipeline."""
    return Model(name, lambda: spacy_model(name)) if name else None


_models: dict[str, Callable | None] = {}


def _loaded(model: Model) -> Callable | None:
    """The model, loaded once in a worker, which outlives its tasks."""
    if model.name not in _models:
        _models[model.name] = model.load()
    return _models[model.name]


def ner_of(model: Model | None):
    """ner_entities with the names of a model, if one is given."""
    if model is None:
        return ner_entities

    @F.pandas_udf(ENTITIES)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trained = _loaded(model)
        one = _guarded(lambda t: entities(t, trained), {"entities": None, "pairs": None, "trigger": None})
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["entities", "pairs", "trigger"])

    return found


#: What any text with a hit of a kind holds, in lower case.
_HELD = {"EMAIL": "@", "MRN": "mrn"}
#: What an address is made of.
_ADDRESS_RUN = re.compile(r"[\w\s,\-.]+")


def pii_hits(text: str | None, kinds: Collection[str] | None = None) -> list[dict]:
    """Hits, of the given kinds or of all, that don't overlap: the surer, then the longer, then the earlier one stays."""
    if not text:
        return []
    low = text.lower()
    hits = [(k, m, c) for k, p, c in _pii() if (kinds is None or k in kinds) and _HELD.get(k, "") in low for m in p.finditer(text)]
    address, code = _address()
    if (kinds is None or lexicon.ADDRESS[0] in kinds) and code.search(text):
        for run in _ADDRESS_RUN.finditer(text):
            if code.search(text, run.start(), run.end()):  # else no address can count, and its pattern takes the square of the run's length
                hits += [(lexicon.ADDRESS[0], m, lexicon.ADDRESS[2]) for m in address.finditer(text, run.start(), run.end()) if code.search(m.group())]
    hits.sort(key=lambda h: (-h[2], h[1].start() - h[1].end(), h[1].start()))
    starts: list[int] = []
    kept: list[dict] = []  # by their starts; they don't overlap, so only the neighbours of a hit can
    for kind, m, c in hits:
        at = bisect.bisect_left(starts, m.start())
        if (at == 0 or kept[at - 1]["end"] <= m.start()) and (at == len(kept) or m.end() <= kept[at]["start"]):
            starts.insert(at, m.start())
            kept.insert(at, {"type": kind, "match": m.group(), "start": m.start(), "end": m.end(), "confidence": c})
    return kept


def without(text: str, hits: list[dict]) -> str:
    """The text with each hit, in order, replaced by its kind."""
    parts, at = [], 0
    for h in hits:
        parts += [text[at : h["start"]], f"<{h['type']}>"]
        at = h["end"]
    return "".join([*parts, text[at:]])


def redact(text: str | None) -> str | None:
    return None if text is None else without(text, pii_hits(text))


def _negated(low: str, at: int) -> bool:
    tokens = re.findall(r"\b[\w'\-]+\b", low[max(0, at - NEGATION_CHARS) : at])[-NEGATION_TOKENS:]
    return bool(tokens) and any(f" {n} " in f" {' '.join(tokens)} " for n in lexicon.NEGATORS)


def _places(low: str, term: str) -> Iterator[int]:
    """Where the term stands between other characters than a-z."""
    at = low.find(term)
    while at >= 0:
        end = at + len(term)
        free = not (at and "a" <= low[at - 1] <= "z") and not "a" <= low[end : end + 1] <= "z"
        if free:
            yield at
        at = low.find(term, end if free else at + 1)


def sentiment(text: str | None) -> dict:
    """Negative terms that a negator precedes count as positive; a trigger with a negative term makes the text adverse."""
    if not text:
        return {"label": "neutral", "score": 0.0, "matched_negative": [], "matched_positive": [], "has_adr_trigger": False, "negated": []}
    low = text.lower()
    negative, negated = [], []
    for term in lexicon.NEGATIVE:
        for at in _places(low, term):
            (negated if _negated(low, at) else negative).append(term)
    positive = [term for term in lexicon.POSITIVE for _ in _places(low, term)] + negated
    n, p, trigger = len(negative), len(positive), triggered(text)
    score = (p - n) / max(1, p + n)
    if trigger and n:
        label, score = "adverse", min(score, -0.5)
    else:
        label = "negative" if n > p else "positive" if p > n else "neutral"
    return {"label": label, "score": round(score, 3), "matched_negative": negative, "matched_positive": positive, "has_adr_trigger": trigger, "negated": negated}


def fuzzy(term: str | None, vocabulary=lexicon.SYMPTOMS, cutoff: float = 0.82, most: int = 8) -> list[str]:
    term = (term or "").strip().lower()
    return difflib.get_close_matches(term, list(vocabulary), n=most, cutoff=cutoff) if term else []


def _guarded(f, empty):
    """A record that fails gives null, not a failed job."""

    def safe(x):
        try:
            return f(x)
        except Exception:
            return empty

    return safe


ENTITIES = T.StructType([T.StructField("entities", T.ArrayType(schemas.ENTITY)), T.StructField("pairs", T.ArrayType(schemas.PAIR)), T.StructField("trigger", T.BooleanType())])


@F.pandas_udf(ENTITIES)
def ner_entities(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_guarded(entities, {"entities": None, "pairs": None, "trigger": None})(x) for x in text], columns=["entities", "pairs", "trigger"])


@F.pandas_udf(T.ArrayType(schemas.PAIR))
def ner_pairs(text: pd.Series) -> pd.Series:
    """The pairs of ner_entities; equal texts of a batch are searched once."""
    found = {x: _guarded(pairs, None)(x) for x in set(text)}
    return pd.Series([found[x] for x in text], dtype="object")


@F.pandas_udf(T.ArrayType(schemas.PII_HIT))
def pii_detect(text: pd.Series) -> pd.Series:
    return text.map(_guarded(pii_hits, None))


@F.pandas_udf(T.StringType())
def pii_redact(text: pd.Series) -> pd.Series:
    return text.map(_guarded(redact, None))


@F.pandas_udf(T.StructType([T.StructField("hits", T.IntegerType()), T.StructField("redacted", T.StringType())]))
def pii_counted(text: pd.Series) -> pd.DataFrame:
    """The number of hits and the redacted text, of one search."""

    def one(x):
        hits = pii_hits(x)
        return {"hits": len(hits), "redacted": without(x, hits)}

    return pd.DataFrame([_guarded(one, {"hits": 0, "redacted": None})(x) for x in text], columns=["hits", "redacted"])


def pii_of(kinds: Collection[str]):
    """A column function from texts to the hits of these kinds, and the text with them redacted."""
    kinds = frozenset(kinds)

    @F.pandas_udf(T.StructType([T.StructField("hits", T.ArrayType(schemas.PII_HIT)), T.StructField("redacted", T.StringType())]))
    def found(text: pd.Series) -> pd.DataFrame:
        def one(x):
            hits = pii_hits(x, kinds)
            return {"hits": hits, "redacted": without(x, hits)}

        return pd.DataFrame([_guarded(one, {"hits": None, "redacted": None})(x) for x in text], columns=["hits", "redacted"])

    return found


@F.pandas_udf(schemas.SENTIMENT)
def sentiment_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sentiment(x) for x in text], columns=schemas.SENTIMENT.names)


@F.pandas_udf(T.StringType())
def sentiment_label(text: pd.Series) -> pd.Series:
    """The label of sentiment_of; equal texts of a batch are judged once."""
    found = {x: sentiment(x)["label"] for x in set(text)}
    return pd.Series([found[x] for x in text], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def fuzzy_neighbours(term: pd.Series) -> pd.Series:
    return term.map(fuzzy)


def register(spark: SparkSession) -> None:
    """For SQL: these functions, and the readers' table functions."""
    for name, f in {"ner_entities": ner_entities, "pii_detect": pii_detect, "pii_redact": pii_redact, "sentiment": sentiment_of, "fuzzy_neighbours": fuzzy_neighbours}.items():
        spark.udf.register(name, f)
    from ..sources import feeds, html

    feeds.register(spark)
    html.register(spark)
