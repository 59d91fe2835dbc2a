"""Small tables with odd rows."""

import random

WORDS = [f"w{k}" for k in range(400)]


def text(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def changed(base, at, word="other"):
    words = base.split(" ")
    words[at] = word
    return " ".join(words)


def documents(spark, rows):
    """``rows`` of (doc_id, text, source); the other columns clash with names used inside."""
    schema = "doc_id long, text string, source string, lang string, n_chars long, id long, value string, n int"
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), 7, "x", 1) for i, t, s in rows], schema)
