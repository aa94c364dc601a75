import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and ear thing bleed stone über été ñandú ça zwölf naïve 東京 idea, idea. (so) it's we'll 12 3456 x=y ###".split()


def make_texts(seed: int = 7, n: int = 60) -> list[str | None]:
    """Null, empty, blank, odd white space, repeats, near copies, special strings and one long text."""
    draw = random.Random(seed)
    texts: list[str | None] = [None, "", " ", "\n\n", "a", "a b", "A  B", "tab\tand nbsp  two", "end<|endoftext|>of text", "\x1cfs\x0bvt", " lead", "trail ", "line\n\nbreak", "é é"]
    for _ in range(n):
        texts.append(" ".join(draw.choices(WORDS, k=draw.randint(1, 60))).replace(" ear ", "\n"))
    texts += [texts[20], texts[20], texts[21] + " ", texts[22].replace(" ", "\n"), texts[23] + " extra"]
    texts.append(" ".join(draw.choices(WORDS, k=30_000)))
    return texts


def make_documents(spark, texts=None, extra: bool = True):
    texts = make_texts() if texts is None else texts
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None), *[rows[min(15, len(rows) - 1)]] * 2]
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that operators use themselves
        from pyspark.sql import functions as F

        for name in ("keep_id", "n", "fp", "block", "kept", "n_tokens", "length", "first", "score"):
            frame = frame.withColumn(name, F.lit("clash"))
    return frame, rows
