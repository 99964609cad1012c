"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wörd{i % 977} tok{i % 31}" for i in range(9000))
TEXTS = [
    None, "", " ", "\n\n\t", "Hello, world! It's 42°C — naïve café.", "Hello, world! It's 42°C — naïve café.", "a" * 500, LONG, LONG,
    "x <|endoftext|> y<|endoftext|>", "日本語のテキスト and Ԥ ՘ ꟎ emoji 🙂🙂", "don't  we'll   \n\n  tabs\t\tend  ", "ab" * 300, "Ġt Ċ \x00 \x85   z",
]


def documents(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *([rows[4], (None, "null id", None, None, None)] if extra else [])], SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("n_tokens", "n_bytes", "key", "n", "kept", "piece")}) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
