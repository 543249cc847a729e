import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + seed * i) % len(WORDS)] + str((seed + i) % 5) for i in range(n))


def rows():
    """Nulls, empty, blank, short and very long texts, copies, near copies, unusual signs."""
    base = prose(3, 120)
    texts = [
        None, "", "   \n\t", "one", "One", "ONE two", "É é ß ſ", "a" * 5000, "x " * 30000, base, base.upper(),
        base.replace("alpha", "omega", 1), base + " more", prose(5, 40), prose(6, 40), prose(7, 2500),
        "Hello <|endoftext|> world", "tab\tand\x0bvertical\x1cseparator\xa0blank", "日本語のテキスト です", "12 34 !!",
        "ünï\r\n\r\ncode 🙂 ok", prose(5, 40) + " tail",
    ]
    langs = ["en", None, "fr"]
    return [
        (i if i else 10**12, t, langs[i % 3], "src0" if i % 2 else None, None if t is None else len(t))
        for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, one of them repeated, with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit(1) for c in ("node", "_row", "_rows", "kept", "shard", "bucket", "ids", "score", "_n")})


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
