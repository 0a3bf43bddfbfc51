"""Small document tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random
import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
])
#: Names that operators use inside or append.
CLASHING = ("size", "n", "key", "shard", "slot", "score", "run", "label", "text_", "copies", "rate", "target", "row_key", "s_group", "whole_text")
EN = "the of and that with from this have which their would there other after under".split()
DE = "der und die nicht eine auch sich werden über schön große straße können müssen wurde".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n, vocabulary=EN):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    base = prose(rng, 80)
    near = base.split(" ")
    out = []
    for i in range(n):
        kind = i % 12
        if kind == 0:
            text = base
        elif kind == 1:
            text = " ".join(w if rng.random() > 0.02 else "changed" for w in near)
        elif kind == 2:
            text = None
        elif kind == 3:
            text = rng.choice(["", "  \t\n", "...", "one", "two words", "ONE"])
        elif kind == 4:
            text = base.replace(" ", "  \n").upper()
        elif kind == 5:
            text = prose(rng, 3000)
        elif kind == 6:
            text = prose(rng, 40, DE)
        else:
            text = prose(rng, rng.randint(1, 120))
        lang = None if kind == 7 else "de" if kind == 6 else "en"
        out.append((i, text, lang, None if kind == 8 else f"s{i % 3}" if kind else "hot"))
    out += [out[13], out[13], (None, "a row without an id", "en", "s0"), (3, "same id, other text", "en", "s1")]
    return out


def table(spark, some=None, clashing=False):
    df = spark.createDataFrame(rows() if some is None else some, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"kept {c}") for c in CLASHING})
    return df.repartition(3)
