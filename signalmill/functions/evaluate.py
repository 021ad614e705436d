"""Recall of the personal-data detectors on made-up posts, by type."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import pii_detect

# Posts with slots, and digits of each slot (9: any digit, 6: one of 6 to 9).
_POSTS = ("Call me at {PHONE_IN} about the rash.", "Aadhaar {AADHAAR}, phone +91 {PHONE_IN}.", "My PAN is {PAN}; write to {EMAIL}.", "Born on {DOB}, {MRN}.", "Mail {EMAIL} or {PHONE_IN}, please.", "File {MRN}: patient born {DOB} has fever.", "{NAME} saw them at {HOSPITAL}.", "We live at {ADDRESS}; ask {NAME}.")


def _value(kind: str, rng: random.Random) -> str:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    return {
        "PHONE_IN": lambda: rng.choice("6789") + digits(9), "AADHAAR": lambda: f"{rng.randint(2000, 9999)} {digits(4)} {digits(4)}", "PAN": lambda: letters(5) + digits(4) + letters(1),
        "EMAIL": lambda: f"{letters(6).lower()}.{digits(2)}@mail.example", "DOB": lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1940, 2010)}", "MRN": lambda: f"MRN: {letters(2)}{digits(6)}",
        "NAME": lambda: f"{rng.choice(('Dr.', 'Mr.', 'Mrs.'))} {letters(1)}{letters(5).lower()}", "HOSPITAL": lambda: f"{letters(1)}{letters(6).lower()} {rng.choice(('Hospital', 'Clinic'))}", "ADDRESS": lambda: f"flat no. {rng.randint(1, 99)}, {letters(1)}{letters(5).lower()} road {rng.randint(1, 8)}{digits(5)}",
    }[kind]()


def posts(spark: SparkSession, n: int = 200, seed: int = 7) -> DataFrame:
    """(text, expected): a post and the types of its slots."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        body, kinds = rng.choice(_POSTS), []
        while "{" in body:
            kind = body[body.index("{") + 1 : body.index("}")]
            kinds.append(kind)
            body = body.replace(f"{{{kind}}}", _value(kind, rng), 1)
        rows.append((body, kinds))
    return spark.createDataFrame(rows, "text string, expected array<string>")


def recall(labelled: DataFrame, text: str = "text", expected: str = "expected") -> DataFrame:
    """(type, expected, found, recall): found hits of a type over expected ones, 1 at most, to three decimals."""
    rows = labelled.select(F.col(expected).alias("e"), F.transform(pii_detect(text), lambda h: h["type"]).alias("f"))
    want = rows.select(F.explode("e").alias("type")).groupBy("type").agg(F.count("*").alias("expected"))
    have = rows.select(F.explode("f").alias("type")).groupBy("type").agg(F.count("*").alias("found"))
    both = want.join(have, "type", "left").fillna(0, ["found"])
    return both.withColumn("recall", F.round(F.least(F.lit(1.0), F.col("found") / F.col("expected")), 3))
