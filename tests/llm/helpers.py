"""Small document tables with the awkward cases, for every operator's tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def awkward_texts(seed: int = 1, n: int = 40) -> list:
    rng = random.Random(seed)
    words = ["the", "Of", "ertion,", "été", "don't", "x***", "12ab", "İσΣ", "日本", "áb"] + ["".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(80)]

    def prose(k):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", "\n", "."]) for _ in range(k))

    base = [prose(rng.randint(1, 120)) for _ in range(n)]
    shared = prose(70)
    base += [base[0], base[0], base[1] + " tail", shared + "\n" + base[2], base[3] + "\n" + shared, shared, prose(3000), "a" * 900, "la " * 700, "<|endoftext|> a <|startoftext|>b", "\x1ca\x1d b", "   \n\n ", "", None, None]
    return base


def table(spark, texts, ids=None):
    rows = [(None if ids is None and i == 7 else (ids[i] if ids else i * 3), t, "en", None if i == 5 else f"s{min(i % 7, 3)}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
