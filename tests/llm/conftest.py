import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Nulls in every column, empty and blank texts, a very long text, equal ids, equal rows, copies, near copies."""
    rng = random.Random(5)
    a, b, c = prose(rng, 120), prose(rng, 90), prose(rng, 40)
    passage = prose(rng, 60)
    near = a.split()
    near[50] = "changed"
    long = " ".join(prose(rng, 30) + "\n" for _ in range(700))
    texts = [a, " ".join(near), a, b + "\n" + passage + "\n" + c, prose(rng, 30) + " " + passage + " end", long, "", " \n\t ", None, None,
             "one", "Two words", "x" * 5000, "aaaa " * 300, "Été über 日本 " * 30, b.upper(), c + "\n" + c + "\n" + c, passage]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (7, a, None, None, None), (None, b, "en", None, 5), (None, None, None, None, None), (None, a, "en", "src0", 1)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = ("rid", "_rid", "pos", "x0", "copy", "spans", "places", "n_removed", "h", "text2", "component_id", "score", "slot", "with.dot")


@pytest.fixture(scope="session")
def clashing(edge):
    return edge.withColumns({c: F.lit(f"own {c}") for c in CLASHING if "." not in c}).withColumn("with.dot", F.lit(1))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
