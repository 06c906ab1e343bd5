import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "the and attion to thanedble anea eriner stheand cióntaó èauxment größe 漢字 don't it's 1234 x\ty".split(" ")


@pytest.fixture(scope="session")
def corpus():
    """Odd rows: nulls everywhere, empty and long texts, ties, repeated rows."""
    import random

    r = random.Random(7)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 120))) for _ in range(40)]
    long = " ".join(r.choice(WORDS) for _ in range(30_000))
    shared = " ".join(r.choice(WORDS) for _ in range(70))
    texts += [None, "", " ", "\n\n", "a", texts[0], texts[1], texts[1] + " more", long, long[:5000] + " cut " + long[9000:], shared, "x " + shared + ".\nend", "<|endoftext|> a  <|endoftext|>", "  double  spaces \n here ", "a" * 3000, "ab" * 700, "é" * 300]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, texts[2], None, None, None), (None, None, None, None, None), (5, texts[5], "en", "s2", len(texts[5])), (5, texts[5], "en", "s2", len(texts[5]))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns named like everything that operators add."""
    from pyspark.sql import functions as F

    names = ["fingerprint", "component_id", "kept", "n_words", "size", "shard", "slot", "n_tokens", "piece", "length", "sequence_id", "spans", "n_assign", "block", "bucket", "fp", "pattern", "owner", "row", "start", "offset"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
