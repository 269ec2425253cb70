"""Small tables with what real ones have: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id string, `_text` int, `a.b` int, FP int, `rank` long, score double"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=3, n=120):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one", "one two", "ONE TWO", "a b c", "A\tB\n\nC ", " x\x0b\x0cy ", "é ß İ Ⅷ ’", "same line\nsame line\nother\n\n\n#$ %& |<>*"]
    base = [words(rng, rng.choice((5, 30, 80, 200))) for _ in range(n)]
    for b in base:
        out.append(" ".join(b))
        if rng.random() < 0.4:
            near = list(b)
            near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
        if rng.random() < 0.3:
            out.append("  ".join(b) + "\n")
    out += ["copy of a text with some words in it"] * 40
    out.append(" ".join(words(rng, 30_000, 5_000)))
    return out


def rows(seed=3, n=120):
    rng = random.Random(seed)
    found = []
    for i, text in enumerate(texts(seed, n)):
        found.append((i, text, "en", rng.choice(["a", "B", "é", None, "z"]) if i % 3 else "hot", len(text or ""), "d", "i", 1, 2, 3, 4, 0.5))
    found += [found[30]] * 3  # repeated rows
    found.append((None, "a row without an id", "en", "a", 3, "d", "i", 1, 2, 3, 4, 0.5))
    rng.shuffle(found)
    return found


def table(spark, seed=3, n=120):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
