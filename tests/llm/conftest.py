import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("shard", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("length", T.StringType()),
    ]
)


def frame(spark, texts, ids=None):
    rows = [(i, t, None, "src", None, "x", None, "b", "l") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def edge_texts():
    """Null, empty and odd texts, copies, near copies, a long text, passages shared by documents."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, shared = prose(220), prose(90)
    near = base.split(" ")
    near[40], near[90] = "OTHER", "words"
    return [
        None, "", " ", "\n\t", "one", "One, two.", base, base, base, " ".join(near), base[:-30] + prose(5), prose(30) + " " + shared + " " + prose(25),
        shared + "\n" + prose(60), prose(3) + shared, "ab " * 500, "ab " * 500, "x" * 2000, "<s> </s> <|endoftext|> a▁b  ▁ c ", "tab\tand\x0bvt\x0cff\rcr\x1cfs\x85nel\xa0nbsp　wide",
        prose(8000), "İstanbul ǅ é ﬁ 中文 字 don't we'll x's 12 345.67 🙂🙂", base.upper(), "a b c d", "a b c d", "A B C D e",
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return edge_texts()


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, ids=None: frame(spark, texts, ids)
