"""Language ID by string kernels.

Two texts are as alike as the n-grams (of 1 to 3 bytes of lower-cased letters) that both hold: the blended-spectrum
presence kernel, normalised by both texts' own counts. Nyström landmarks turn it into a short vector and one-versus-rest kernel
ridge regression scores each language. Batches of texts are scored by two matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}").search
#: Bytes of UTF-8 above 0x7F and a-z are told apart, by numbers from 1; all else is a gap, 0.
_CLASSES = bytes(c - 96 if 97 <= c <= 122 else c - 101 if c >= 128 else 0 for c in range(256))
_SIDE = 155
_TWO, _THREE, _CODES = _SIDE, _SIDE + _SIDE**2, _SIDE + _SIDE**2 + _SIDE**3


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes of the n-grams that are looked at
    landmarks: np.ndarray  # landmarks x grams, 0 and 1
    weights: np.ndarray  # landmarks x languages, over normalised kernel values
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """The place of each n-gram's code; kept by the worker, for one model at a time."""

        def build():
            table = np.full(_CODES, len(self.grams), dtype=np.int32 if len(self.grams) > 32_000 else np.int16)
            table[self.grams] = np.arange(len(self.grams))
            return table

        return common.held(("language", self.grams.tobytes()), build)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The regression values of each text, and the share of its n-grams (repeats included) that the model looks at."""
        table, n = self.table(), len(self.grams)
        present, known = np.zeros((len(texts), n + 1), dtype=np.float32), np.zeros(len(texts))
        for k, text in enumerate(texts):
            seen = 0
            for codes in (all_codes := gram_codes(text)):
                places = table[codes]
                present[k, places] = 1
                seen += np.count_nonzero(places < n)
            known[k] = seen / max(1, sum(map(len, all_codes)))
        return kernel(present[:, :n], self.landmarks) @ self.weights + self.bias, known


def gram_codes(text: str) -> list[np.ndarray]:
    b = np.frombuffer(text.lower().encode("utf-8").translate(_CLASSES), dtype=np.uint8).astype(np.int32)
    two = b[:-1] * _SIDE + b[1:]
    return [b, two + _TWO, two[:-1] * _SIDE + b[2:] + _THREE]


def distinct_codes(text: str) -> np.ndarray:
    return np.unique(np.concatenate(gram_codes(text))).astype("<i4")


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common n-grams over the root of both counts; 0 with an empty text."""
    common_ = (a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T).astype(np.float64)
    na, nb = a.sum(axis=1, dtype=np.float64), b.sum(axis=1, dtype=np.float64)
    return common_ / np.sqrt(np.maximum(1, na))[:, None] / np.sqrt(np.maximum(1, nb))[None, :]


def fit(samples: list[tuple[str, np.ndarray]], grams: np.ndarray, landmarks: int, ridge: float) -> Model | None:
    """samples: (language, places in grams of the n-grams that the text holds), in an order that decides ties and the choice
    of landmarks."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    x = np.zeros((len(samples), len(grams)), dtype=np.float32)
    for row, (_, own) in zip(x, samples):
        row[own] = 1
    y = np.array([languages.index(s) for s, _ in samples])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel(x, marks) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language counts alike, however many samples it has.
    weight = (1.0 / np.bincount(y))[y][:, None] * len(y) / len(languages)
    mean_z, mean_t = (z * weight).sum(0) / weight.sum(), (target * weight).sum(0) / weight.sum()
    zc = z - mean_z
    solved = np.linalg.solve(zc.T @ (zc * weight) + ridge * np.eye(z.shape[1]), zc.T @ ((target - mean_t) * weight))
    return Model(languages, grams, marks.astype(np.uint8), root @ solved, mean_t - mean_z @ solved)


#: The bounds of what is learnt from: rows of a language, rows in all (at least one a language), languages, landmarks of a
#: language, n-grams. A labelled row's share of what is collected is a bit for each n-gram, however long its text is.
PER_LANGUAGE, MOST_ROWS, MOST_LANGUAGES, LANDMARKS, FEATURES, RIDGE = 400, 4_000, 1_000, 48, 8192, 0.5


def learn(df: DataFrame, where, text: str = "text", lang: str = "lang", order: str = "doc_id", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, landmarks: int = LANDMARKS, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """A model of the rows of df that `where` picks and that have a text with a letter and a non-null language. Of each
    language at most `per_language` rows, those with the smallest hashes of `order` and text, and `most_rows` in all; of more than
    MOST_LANGUAGES languages those with the most such rows. None without rows, as of an empty table. Texts are read whole, of any
    length; rows that repeat count as often as they come, ties of hashes go by the text."""
    spark = df.sparkSession
    common.ship(spark)
    rows = df.where(where & df[lang].isNotNull() & df[text].rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(order, text).alias("h"))
    place = F.col("h").bitwiseAND(F.lit(2**63 - 1))
    told = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("h").alias("kinds"), F.min(place).alias("least"))
    counts = told.orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    each = max(1, min(per_language, most_rows // len(counts)))
    # A hash bound that leaves about twice as many rows that differ, and one at least; ranking then takes a few rows of each language. Rows that
    # repeat have one hash, so that they are ranked in parts first.
    bound = {r["lang"]: max(r["least"], min(2**63 - 1, (2**63 - 1) * (2 * each + 40) // max(1, r["kinds"]))) for r in counts}
    limits = spark.createDataFrame(list(bound.items()), "lang string, bound long")  # one row a language
    few = rows.join(F.broadcast(limits), "lang").where(place <= F.col("bound")).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    for over in (["lang", "part"], ["lang"]):
        few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*over).orderBy("h", "text"))).where(F.col("nth") <= each)
    coded = common.map_rows(few.select("lang", "nth", "text"), ["text"], [("codes", T.ArrayType(T.IntegerType()))], lambda: lambda columns: [[distinct_codes(t).tolist() for t in columns[0]]])
    sample = common.materialise(spark, coded.drop("text"), "language-sample")
    top = sample.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy(F.desc("count"), "code").limit(features)
    grams = np.array(sorted(r["code"] for r in top.collect()), dtype="<i4")  # `features` rows

    def make():
        def work(columns):
            out = []
            for codes in columns[0]:
                own = np.array(codes, dtype="<i4")
                held = np.zeros(len(grams), dtype=np.uint8)
                at = np.searchsorted(grams, own)
                at[at == len(grams)] = 0
                held[at[grams[at] == own]] = 1
                out.append(np.packbits(held).tobytes())
            return [out]

        return work

    got = common.map_rows(sample, ["codes"], [("held", T.BinaryType())], make).select("lang", "nth", "held").collect()  # a bit an n-gram
    held = [(r["lang"], np.flatnonzero(np.unpackbits(np.frombuffer(r["held"], dtype=np.uint8))[: len(grams)])) for r in sorted(got, key=lambda r: (r["lang"], r["nth"]))]
    return fit(held, grams, landmarks, ridge)


#: Texts of one matrix product.
BATCH = 128


def predict(df: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """df with the language of each whole text and a score of 0 to 1 (the share of the best language in the exponentials of all
    languages' regression values), and, if named, in column `known` the share of the text's n-grams that the model looks at: low
    for a text in no learnt language. Null texts and such without any letter get `und` and zeros, and so do all without a model.
    Ties go to the language that sorts first. Texts of any length are read whole, in slices of bounded bytes; an empty table gives an
    empty one. Rows are kept as they come, repeated ones alike; columns of df with the name of a new one are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks x features
    (source,) = common.fresh(df, "_lang_text")
    added = [(pred, T.StringType()), (score, T.DoubleType()), *([(known, T.DoubleType())] if known else [])]
    rows = df.withColumn(source, df[text]).drop(*(c for c in df.columns if c.lower() in {n.lower() for n, _ in added}))

    def make():
        m = shared.value
        if m is not None:
            m.table()

        def work(columns):
            texts = columns[0]
            some = [k for k, t in enumerate(texts) if m is not None and t and _LETTER(t)]
            out = [[UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)]
            for at in range(0, len(some), BATCH):
                own = some[at : at + BATCH]
                s, seen = m.scores([texts[k] for k in own])
                top = s.argmax(axis=1)
                share = 1 / np.exp(3 * (s - s.max(axis=1, keepdims=True))).sum(axis=1)
                for k, t, p, q in zip(own, top.tolist(), share.tolist(), seen.tolist()):
                    out[0][k], out[1][k], out[2][k] = m.languages[t], round(min(1.0, p), 6), round(q, 6)
            return out[: len(added)]

        return work

    return common.map_rows(rows, [source], added, make).drop(source)
