"""Small fixtures and brute-force parts that the tests share."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n):
    r = random.Random(seed)
    parts = "the of and ing tion er re al ver lo mi sta qua zo ten bra".split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


#: Nulls in any column, empty and blank texts, no letters, repeated rows, a null and a repeated id, one very long text.
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "!!! 123 ###"), (5, prose(5, 80)), (5, prose(5, 80)), (6, prose(5, 80)), (7, prose(7, 60), None, None), (None, prose(8, 70)),
    (8, "a"), (9, "word " * 30_000), (10, prose(10, 40) + "\n" + prose(11, 40) + "\n" + prose(10, 40)),
]


class Union:
    def __init__(self, items):
        self.p = {x: x for x in items}

    def find(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.p[max(a, b)] = min(a, b)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
