import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with a documents table of awkward rows: nulls everywhere, empty and long texts, repeats, odd characters, a clashing column."""
    long = "word%d " * 3 + "\n"
    texts = [
        None, "", " \t\n", "One two", "one TWO", "alpha beta gamma delta", "alpha beta gamma delta", "ÄÖ é ß   x\x1cy İ",
        "a" * 5000, "\n".join(long % (i, i + 1, i + 2) for i in range(3000)), "mail a.b+c@x-y.co.uk, b.c_d@e.f!! +1 (732) 555-3520 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 +123 +12345678 " + "1" * 40, "a@b.c_d@e.f @@ x@y z@q..r é@x.y", "<|endoftext|> foo<|startoftext|>bar don't 'tis ,'s 3.14",
        "x y z x y z x y z\nx y z\n\nx y z", "😀 😀 😀 4111111111111111😀 +4912345678.", "phone: (212) 555-1234 or me (at) mail.com",
    ]
    rows = [(i, t, ("s%d" % (i % 3)) if i % 5 else None, i * 1.5) for i, t in enumerate(texts)]
    rows += [(None, "null id text here", "s0", None), (None, None, None, None), (5, texts[5], None, 7.5), (5, texts[5], None, 7.5)]
    at = str(tmp_path_factory.mktemp("odd"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.DoubleType())])
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.read.parquet(f"{odd}/documents.parquet").where("false").write.parquet(f"{at}/documents.parquet")
    return at
