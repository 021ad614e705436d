"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary
identifiers, compared by log-likelihood ratio. DataFrame functions only.
"""

from __future__ import annotations

import math
import random
import string
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The kinds in their order, each with its pattern, the group that is measured and its least length.
PATTERNS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # [A-Z0-9]+ takes all of a run, so asking for 16 finds the same
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # likewise
]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
MARKOV = "markov"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-"
SIDE = len(ALPHABET) + 1
#: Natural-log units, in thousandths, by which a string must be likelier as random, for each of its characters: above
#: words of languages that the samples don't have (up to 610), below nearly all random strings.
MARGIN = 700

# Words that identifiers, paths and dated names are made of.
WORDS = """
account action active address admin alert alias amount archive argument array article asset attribute author balance batch billing block body branch bucket
buffer build button cache calendar callback category channel character check child class client cluster code collection color column command comment commit common company
component condition config connection constant contact container content context control counter country course create currency current customer daily data database date debug decimal
decoder default delete delivery department description detail device dialog dictionary directory document domain download driver duration editor element email employee encoder endpoint engine
entity error event example exception execute export extension factory feature field file filter folder format forum frame function gateway general global graph group handler
header height history host html image import index information input install instance integer interface internal international invoice issue item journal keyboard kernel language layout
letter level library license limit link list listener loader local location logger login manager mapping margin market master member memory message method metric middle minute
mobile model module monitor month network notification number object office operation option order organization original output overview package page panel parameter parent partner password
patient payment people percent period permission person picture platform player plugin policy position preference previous price primary printer priority private process product profile program project
""".split()

#: Labelled samples of each kind, of which every fifth is held out.
SAMPLES, HELD_OUT = 4_000, 5


def _pick(rng: random.Random, of) -> str:
    return of[int(rng.random() * len(of))]


def ordinary_samples() -> list[str]:
    """Labelled 0: words alone, and joined as names, constants, paths, slugs and dated names are; long numbers, rules of one character and
    stretches of the alphabet. The generator's random() is the same in every version of Python, and nothing else is drawn from."""
    rng = random.Random(11)
    made = list(WORDS)
    for k in range(SAMPLES):
        parts = [_pick(rng, WORDS) for _ in range(2 + int(4 * rng.random()))]
        year = str(1990 + int(45 * rng.random()))
        number = str(int(10 ** (1 + 2 * rng.random())))
        made.append([
            "_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "".join(p.title() for p in parts), "_".join(parts).upper(),
            "/".join([*parts[:2], year, "-".join(parts[2:])]), "_".join([*parts, number]), "-".join([year, *parts]), "".join(parts),
            "".join(_pick(rng, string.digits) for _ in range(20 + int(20 * rng.random()))), _pick(rng, ALPHABET) * (20 + int(40 * rng.random())), (_pick(rng, (string.ascii_lowercase, string.ascii_uppercase + string.digits)) * 3)[int(26 * rng.random()) :][: 20 + int(20 * rng.random())],
        ][k % 13])
    return made


def random_samples() -> list[str]:
    """Labelled 1: drawn evenly from the alphabets that keys are written in."""
    rng = random.Random(12)
    letters = string.ascii_letters
    kinds = ["0123456789abcdef", letters + string.digits, letters + string.digits + "+/", letters + string.digits + "_-", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, letters, string.ascii_lowercase]
    return ["".join(_pick(rng, kinds[k % len(kinds)]) for _ in range(20 + int(45 * rng.random()))) for k in range(SAMPLES)]


def learnt(samples: list[str]) -> list[str]:
    return [s for k, s in enumerate(samples) if k % HELD_OUT]


def held_out(samples: list[str], least: int = 20) -> list[str]:
    """Those that a scan would look at."""
    return [s for k, s in enumerate(samples) if k % HELD_OUT == 0 and len(s) >= least]


def transitions(samples: list[str]) -> list[list[float]]:
    """Log-probabilities of a character after another (0: the start), with add-half smoothing."""
    counts = [[0.5] * SIDE for _ in range(SIDE)]
    index = {c: k + 1 for k, c in enumerate(ALPHABET)}
    for s in samples:
        last = 0
        for c in s:
            counts[last][index[c]] += 1
            last = index[c]
    return [[math.log(x / sum(row[1:])) for x in row] for row in counts]


@cache
def ratios() -> tuple[int, ...]:
    """Thousandths of the log-likelihood ratio, by SIDE * earlier + later."""
    a, b = transitions(learnt(random_samples())), transitions(learnt(ordinary_samples()))
    return tuple(round(1000 * (x - y)) for r, s in zip(a, b) for x, y in zip(r, s))


def ratio(token: str) -> int:
    """The same sum as the column expression's, in thousandths."""
    at = [ALPHABET.index(c) + 1 for c in token]
    return sum(ratios()[SIDE * a + b] for a, b in zip([0, *at], at))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a plain column in a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


_BLOCK = 128
_SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _starts(steps: Column) -> Column:
    """Sums of all earlier numbers, for each; by sums of blocks, so that long arrays don't take their square."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    heads = _let(blocks, lambda own: F.transform(F.sequence(F.lit(1), F.size(own)), lambda b: _sum(F.slice(own, F.lit(1), b - 1))))
    return _let(heads, lambda head: F.transform(steps, lambda _, i: head[F.floor(i / _BLOCK).cast("int")] + _sum(F.slice(steps, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))


def _located(text: Column, pattern: str, accept: Callable[[Column], Column], group: int, kind: str, order: int) -> Column:
    """Leftmost non-overlapping matches whose `group` is accepted, as spans in code points. The text between matches
    gives the offsets."""
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.length(s))
    fits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), accept)

    def spans(x: Column) -> Column:
        gap, size = F.slice(x["between"], F.lit(1), F.size(x["whole"])), x["whole"]
        starts = _let(F.zip_with(gap, size, lambda a, b: a + b), _starts)
        zipped = F.arrays_zip(starts.alias("s"), gap.alias("g"), size.alias("n"), x["fits"].alias("f"))
        start = lambda y: y["s"] + y["g"]
        return F.transform(F.filter(zipped, lambda y: y["f"]), lambda y: F.struct(start(y).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start(y) + y["n"]).alias("end")))

    found = _let(F.struct(between.alias("between"), whole.alias("whole"), fits.alias("fits")), spans)
    return F.when(text.rlike(pattern), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _at_least(n: int) -> Callable[[Column], Column]:
    return lambda s: F.length(s) >= n


def _random_like(token: Column) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios()))), ",").cast("array<int>")
    return _total(token, table) > F.length(token).cast("long") * MARGIN


def _total(token: Column, table: Column) -> Column:
    marks = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda acc, k: F.struct(k.alias("last"), (acc["sum"] + F.get(table, acc["last"] * SIDE + k)).alias("sum"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum")), step, lambda acc: acc["sum"])


def _left_random(text: Column, over: Column, e: Column) -> Column:
    """Whether base spans `over` leave some of a candidate, and it or what they leave of it looks random."""
    piece = lambda a, b: F.substring(text, a + 1, F.greatest(F.lit(0), b - a))
    step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["start"])).alias("out"))
    left = F.aggregate(over, F.struct(e["start"].alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], e["end"])))
    return _let(left, lambda rest: (F.length(rest) > 0) & (_random_like(rest) | (F.size(over) > 0) & _random_like(piece(e["start"], e["end"]))))


def find_secrets(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "secret_spans", partly: bool = False) -> DataFrame:
    """df with two arrays of (start, ord, kind, end), sorted: `base` has the matches of the fixed patterns,
    `spans` also those strings of 20 and more characters that the Markov model of random strings explains better
    (by MARGIN a character), where no base match overlaps them (`partly`: strings that base matches cover in part are spans as a whole, if
    the model takes either all of the string or what base matches leave of it for random). Offsets are code points, ends exclusive.

    Null texts count as empty and have none. Whole texts are scanned, of any length; rows are kept as they come, repeated ones
    too, and an empty table gives an empty one. Of spans with one start, kinds come in the order listed. Columns of df with the name of a new one are replaced.
    """
    source, extra = common.fresh(df, "_secret_text", "_secret_extra")
    rows = df.withColumn(source, F.coalesce(df[text], F.lit(""))).drop(base, spans)
    t = F.col(source)
    kinds = [_located(t, p, _at_least(n), g, kind, k) for k, (kind, p, g, n) in enumerate(PATTERNS)]
    held = _located(t, CANDIDATE, (lambda _: F.lit(True)) if partly else _random_like, 0, MARKOV, len(PATTERNS))
    rows = rows.withColumns({base: F.array_sort(F.concat(*kinds)), extra: held})
    if partly:
        taken = lambda e: ~_left_random(t, F.filter(base, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])), e)
    else:
        taken = lambda e: F.exists(base, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))
    apart = F.when(F.size(extra) == 0, F.col(extra)).otherwise(F.filter(extra, lambda e: ~taken(e)))
    return rows.withColumn(spans, F.array_sort(F.concat(F.col(base), apart))).drop(source, extra)


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each stretch of overlapping spans replaced; null stays null."""
    done = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        out = F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, done, step, rest))
