import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("note", T.StringType()),
])


def words(seed: int, n: int) -> list[str]:
    import random

    r = random.Random(seed)
    return ["".join(r.choice(["an", "the", "ra", "é", "mo", "K", "ö"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def text(seed: int, n: int, line: int = 14) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


def edge_rows() -> list[tuple]:
    """Null ids and texts, empty, blank and very long texts, exact and near copies, repeated rows and ids."""
    base = text(1, 300)
    near = base.replace(base.split()[40], "changed", 1)
    moved = "Intro words here. " + base.split("\n", 3)[3]
    texts = {
        1: base, 2: text(2, 120), 3: base, 4: near, 5: None, 6: "", 7: " \n\t ", 8: text(8, 60_000, 9), 9: "one", 10: "one", 11: moved,
        12: "ab " * 400, 13: "ab " * 500, 14: "\n\n" + text(2, 120) + "\n", 15: "naïve 😀   ''ll it's  \r\n\r\n  end", 16: text(16, 70).upper(), 17: "x" * 5000,
    }
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i != 4 else None, None if t is None else len(t), "n") for i, t in texts.items()]
    return rows + [rows[1], rows[3], (None, base, "en", "s0", 1, None), (None, None, None, None, None, None), (9, text(9, 80), "de", "s1", 1, "other text, same id")]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shuffled(df):
    """The same rows over many partitions, in another order."""
    from pyspark.sql import functions as F

    return df.repartition(7, F.rand(3))
