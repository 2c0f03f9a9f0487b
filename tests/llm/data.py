"""Small tables with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, place string, digest string, n string"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("aehinorst") for _ in range(r.randint(2, 7))) for _ in range(n)]


def prose(seed: int, n: int = 120) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[i : i + 12]) for i in range(0, n, 12))


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near and exact copies."""
    texts = [(i, prose(i)) for i in range(40)]
    texts += [(100 + i, prose(1)) for i in range(30)]  # a large group of exact copies
    texts += [(200 + i, prose(2).replace(words(2, 120)[60], f"changed{i}", 1)) for i in range(8)]  # near copies
    texts += [(300, None), (301, ""), (302, ""), (303, " \n\t"), (304, "one"), (305, "one two three")]
    texts += [(None, prose(5)), (None, None), (400, prose(7)), (400, prose(7)), (401, "x" * 60_000), (402, prose(9, 9000))]
    out = [(i, t, ("en", "de", None)[k % 3], ("src0", "src1", "src5", None)[k % 4], None if k % 5 == 0 else k, "r", None, "d", str(k)) for k, (i, t) in enumerate(texts)]
    return out + [out[3], out[3], (None,) * len(out[0])]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).coalesce(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_table(spark, path, some=None):
    """The same rows as a table on disk."""
    documents(spark, some).repartition(3).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
