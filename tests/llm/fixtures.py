"""Small tables with nulls, empty and long texts, repeated rows and clashing column names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, windows int, node long"
WORDS = "stone river amber quiet lantern orchard meadow copper winter harbor silver garden thunder marble forest candle".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(n))


def texts() -> list[tuple]:
    passage = prose(99, 70)
    rows = [
        (1, prose(1, 200), "en", "web"),
        (2, prose(2, 80) + "\n" + passage + "\t" + prose(3, 30), "en", "web"),
        (3, prose(4, 20) + " " + passage + " " + prose(5, 10), None, "book"),
        (4, passage, "en", None),
        (5, None, None, "web"),
        (6, "", "en", "book"),
        (7, " \n\t ", "en", "wiki"),
        (8, "one", "en", "wiki"),
        (9, prose(1, 200), "en", "web"),
        (10, prose(1, 199) + " Changed", "en", "web"),
        (11, " Straße 中文 \u0001   naïve", "de", "web"),
        (12, ("loop " * 30_000).strip(), "en", "web"),
        (13, "mail a.b@c.de or +49 (30) 1234-5678, 10.0.0.1 and 4111 1111 1111 1111", "en", "web"),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, lang, source, len(t or ""), 7, 7, 7, 7) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3, F.col("doc_id"))


def rows(df, *order):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(str(r[c]) for c in order or df.columns))
