"""Documents with every awkward case, and with columns named like results."""

import random

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, class_id int, lang_pred string, prob string, tokens int, digest string, row int"


def prose(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "light", "garden", "winter", "paper", "silver", "bridge", "morning", "letter", "forest", "window", "harbour"]
    return " ".join(rng.choice(words) + (str(rng.randint(0, 99)) if rng.random() < 0.4 else "") for _ in range(n))


def documents(spark):
    base = prose(1, 80)
    near = " ".join(w if i != 40 else "changed" for i, w in enumerate(base.split()))
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "a"), (4, None, "en", "b"), (5, "", None, None), (6, " \t\n ", "en", None),
        (7, LONG, "de", "b"), (8, LONG + " ende", "de", "b"), (9, "12345 678", None, "c"), (10, "Grüße\nGrüße\nGrüße " + prose(2), "de", "a"), (None, base, "en", "a"), (None, "ohne nummer " + prose(3), None, None),
        (11, "x", "en", "a"), (12, prose(4) + " " + base, "en", "c"), (13, "\u0000 null \x1c sep   line é̀ ΣΑΣ 日本語 <|endoftext|> " + prose(5), "fr", "c"), (2, "another text of the same id " + prose(6), "en", "a"),
    ]
    texts += [(100 + i, prose(7, 40), "en", "hot") for i in range(60)] + [(200 + i, prose(100 + i, 50), random.Random(i).choice(["en", "de"]), "hot") for i in range(40)]
    rows = [(i, t, lang, source, len(t or ""), "no", 0.5, 7, "xx", "p", 3, "d", 9) for i, t, lang, source in texts]
    return spark.createDataFrame(rows, SCHEMA)


def pages(spark):
    rows = [(1, "http://a.example/x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a.example/\r\nWARC-Type: evil", None), (4, "http://b.example", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (6, "u", LONG), (7, "u", "é" * 10)]
    rows += [(10 + i, "h", "<p>hot</p>") for i in range(50)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, value string")


def embeddings(spark):
    rng = random.Random(31)
    nan, inf = float("nan"), float("inf")
    vector = lambda: [rng.uniform(-0.3, 1.0) for _ in range(6)]
    rows = [(i, vector(), i % 3) for i in range(60)] + [(1000 + i, [0.5, 0.25, -0.125, 0.75, 0.0, 1.0], i % 2) for i in range(80)]
    rows += [(100, vector(), None), (150, None, 1), (200, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (250, [0.1, nan, 0.2, 0.3, 0.4, 0.5], 1), (300, [inf] * 6, 2), (None, vector(), 1)]
    rows += [(350, [0.5, 0.5], 1), (351, [0.5, 0.4], 1), (352, [0.5, 0.3], 2), (400, [], 1), (401, [], 1), (402, [], 2), (450, vector(), -1), (3, vector(), 0), (500, [0.9] * 6, 1), (500, [0.9] * 6, 1), (550, [-1.0] * 6, 7)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, score string")


def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 1), (None, 1, 1), (2, 1, 0), (10, 1, None), (999_999, 1, 1)] + [(100 + i, i % 2, i % 3 == 0) for i in range(50)]
    return spark.createDataFrame([(a, b, None if c is None else int(c), 5) for a, b, c in rows], "doc_id long, quality int, toxic int, n int")
