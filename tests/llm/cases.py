"""Small tables with the odd cases that every operator has to take."""

import random

WORDS = {"en": "the of and to in that was with from this which they have were their would there about".split(),
         "de": "der die und nicht eine ist von mit auf für über schön werden können müßte jedoch".split()}
EXTRA = ("size", "md5", "keys", "n", "label", "score", "h", "lang_pred", "features", "ids", "tid", "block")


def prose(seed, n, lang="en"):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "er", "ing", "s", "lich", "ten"]) for _ in range(n))


def odd_documents(spark, extra=True):
    """Null in any column, empty, blank, very long and equal texts, repeated rows, columns with clashing names."""
    a, b = prose(1, 60), prose(2, 80, "de")
    near = a.split()
    near[30] = "changed"
    rows = [(1, a, "en", "s1", len(a)), (2, a, "en", "s1", len(a)), (3, " ".join(near), "en", None, None),
            (4, b, "de", "s2", len(b)), (4, b, "de", "s2", len(b)), (5, None, "en", "s1", None),
            (6, "", "de", "s2", 0), (7, " \t\n ", None, "s2", 4), (8, prose(3, 30000), "en", "s1", 0),
            (9, "one", "en", "s3", 3), (10, "12345 67890 !!", None, None, 14), (None, prose(4, 50), None, None, None),
            (11, "x" * 5000, "en", "s3", 5000), (12, "日本語 テキスト ▁ 𝕏", "ja", "s3", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.selectExpr("*", *(f"{i} AS {c}" for i, c in enumerate(EXTRA)))
    return df


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
