"""Small document tables with every awkward case."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("version", T.StringType()),
        T.StructField("_doc", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("fp", T.StringType()),
    ]
)


def documents(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    data = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "v", "d", "z", "f") for r in rows
    ]
    return spark.createDataFrame(data, DOCUMENTS)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


class Parts:
    """Union-find for brute-force components."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
