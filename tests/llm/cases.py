"""Documents that operators must take: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

EXTRA = ["range", "key", "row", "text_hash", "bits", "size", "count", "score", "held_out", "arc", "__id", "id__", "__hash", "hash__", "a.b", "c d", "e`f", "first", "label"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "lang", "source")), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in EXTRA)]
)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = [(i, words(rng, rng.randrange(0, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None])) for i in range(n)]
    shared = words(rng, 40)
    out += [(100, out[3][1], "en", "a"), (101, f"{words(rng, 20)} {shared} {words(rng, 9)}", "en", "a"), (102, f"{shared}\n\n{words(rng, 30)}", "en", "b"), (103, f" {out[5][1]} tail", "en", "a")]
    out += [(None, "an id is missing here", "en", "a"), (None, None, None, None), (104, None, "en", "a"), (105, "", "en", "a"), (106, "  \t\n ", "en", "a")]
    out += [(107, words(rng, 30_000, 50_000), "en", "a"), (108, "Naïve été 字 word", "fr", "b"), (108, "Naïve été 字 word", "fr", "b"), (109, "one", "en", "a"), (110, "x " * 300, "en", "a")]
    return out


def documents(spark, data=None):
    data = rows() if data is None else data
    full = [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
