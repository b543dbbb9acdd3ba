"""The hash embedder takes one digest of a text, and gives the digest's bytes."""

from hashlib import sha256

from tidemark.functions import vectors as V


def test_one_digest_and_its_bytes(spark):
    texts = ["", "alpha", "née 数", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for dim in (4, 96, 100):
        made = df.select("text", V.hash_embedding("text", dim).alias("e"))
        plan = made._jdf.queryExecution().analyzed().toString()
        assert plan.count("sha2(") == 1 and plan.index("sha2(") < plan.index("lambdafunction(")
        for r in made.collect():
            d = sha256((r["text"] or "").encode()).digest()
            assert r["e"] == [d[i % 32] / 127.5 - 1.0 for i in range(dim)]
