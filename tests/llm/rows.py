"""Small documents tables with what real ones may hold."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    """``texts`` as a documents table over three partitions, with columns whose names may clash."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({n: F.lit(1) for n in ("_key", "_look", "_spans", "id", "bucket", "count", "anchor", "text_sha256")})


def prose(n, seed=0, vocabulary=5000):
    import numpy as np

    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))
