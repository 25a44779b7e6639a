"""Small tables with the odd cases that every corpus operator has to stand."""

import random

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, digest string, "
              "findings string, blob string, first int, `rank` int, n_words long, host string, tokens array<long>")
CLASH = (0.5, "d", "f", "b", 1, 2, 3, "h", [1])


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(names) for _ in range(n))


def documents(spark, texts, lang="en", source="a"):
    """(doc_id, text) or (doc_id, text, lang, source) rows with extra columns whose names operators use inside."""
    rows = [(r + (lang, source))[:4] if len(r) == 2 else r for r in texts]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *CLASH) for r in rows], DOC_SCHEMA)


def odd_texts():
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (None, "an id is missing here but the text is not, is it"), (2**60 + 1, "big id"),
            (5, long), (6, "same text twice"), (6, "same text twice"), (7, "same text twice"), (8, "\n\n\n"), (9, "日本 語 ½ ſ\x85x")]


def labels(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, quality int, toxic int, score double")
