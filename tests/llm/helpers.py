"""Small corpora with every awkward row."""

import random

from pyspark.sql import types as T

#: Column names that the operators use inside, as extra columns of the input.
CLASHING = "key n sig bands rep bucket d th size turn row piece length rank block kind side gone at h w n_words failure_bits copies __m".split()

WORDS = [a + b for a in ("th", "er", "on", "in", "re", "st") for b in ("a", "e", "ing", "ly", "ou", "en")]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed: int = 3) -> list[tuple]:
    """(doc_id, text, source) with nulls, empties, copies, near copies, shared passages and one long text."""
    r = random.Random(seed)
    base = sentence(r, 80)
    passage = sentence(r, 60)
    shared = [sentence(r, 12) for _ in range(4)]
    texts = [None, "", " \t\n\r\x0b\x0c ", "one", "one two three", "ONE two\tthree four", base, base, base.upper()]
    for k in (1, 2, 4, 9, 30):
        w = base.split()
        for _ in range(k):
            w[r.randrange(len(w))] = "zz" + str(r.randrange(99))
        texts.append(" ".join(w))
    texts += [sentence(r, 30) + "\n" + passage + "\n" + sentence(r, 30) for _ in range(3)]
    texts += ["\n".join([sentence(r, 5), *shared[:3], sentence(r, 9)]), "\n".join([*shared, "x", "x", "x"]), "\n".join(shared[1:3] * 3), "é ü\u00a0ß \U0001f600 " * 30]
    texts += ["a a a a a a " * 20, "# % & | < > * $ " * 20, sentence(r, 9000)]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(6, base, "s0"), (6, base, "s0")]  # rows that repeat
    return rows


def frame(spark, rows, null_id=True):
    """The corpus as a table, with a null id and extra columns whose names clash."""
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("source", "string")
    for c in CLASHING:
        schema = schema.add(c, "string")
    rows = [(*r, *["x"] * len(CLASHING)) for r in rows]
    if null_id:
        rows.append((None, "a row without an id " * 20, "s1", *[None] * len(CLASHING)))
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], T.StructType().add("doc_id", "long").add("text", "string").add("source", "string"))
