import random

import pytest
from pyspark.sql import functions as F

SF0001 = "/root/testdata/sf0.001"
VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
#: Columns named like the operators' own, and one in another case.
CLASHING = ["score", "_row", "_text", "kept", "component", "ids", "SHARD", "runs", "block"]


def words(rng, n, vocabulary=4000):
    return " ".join("".join("bdfgklmnprst"[c] + "aeiou"[c % 5] for c in divmod(rng.randrange(min(vocabulary, 144)), 12)) + "aeiouy"[rng.randrange(6)] * rng.randrange(3)
                    for _ in range(n))


def make_texts(seed=5):
    """Plain, copied, nearly copied, empty, null, short, odd and very long texts; ids repeat."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(5, 300)) for _ in range(30)]
    passage = words(rng, 70)
    texts = [*base, base[0], base[0], base[1]]
    for b in base[:8]:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(5)]
    texts += [None, "", None, "", " \t\n", "one", "one", "ONE two", "é" * 300, "a" * 900, "naïve Straße ΑΣ İ 漢字 \U0001f600 <|endoftext|> x's\x1cy"]
    texts += ["x " * 40_000 + words(rng, 20_000), words(rng, 500) * 2]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, base[3]), (None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "b").otherwise("a"))
    for n, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(n))
    return df.cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
