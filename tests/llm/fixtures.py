"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    r = random.Random(4)
    words = ["the", "of", "anntion", "ère", "über", "don't", "x", "12", "naïve", "Thing.", "and,", "[END]", "日本"]
    prose = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(40)]
    return [*prose, *prose[:6], prose[0] + " more", "", "   ", None, "a" * 3000, "\n\n", "a  b   c\n d \n\n  e ", "x<|endoftext|>y <|startoftext|>", "é é́ é ́x", "tab\there\x0bthere", " ".join(prose)]


def documents(spark):
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 9 == 0 else f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (5, "another text of five", None, "src1", 20)]
    extra = ["size", "start", "bucket", "tie", "skey", "n", "p", "first", "kept", "part", "score", "n_words"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in extra])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
