"""Small invented tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing names."""

import random

WORDS = "river stone amber quiet lantern meadow copper drift hollow ember willow granite saffron tundra velvet cinder harbor juniper ledger marrow".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))


def texts():
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    passage = prose(2, 60)
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One two"), (9, "one two"), (10, prose(3, 80) + "\n" + passage + "\n" + prose(4, 80)),
        (11, prose(5, 90) + " " + passage), (12, "line of text here\n" * 60), (13, prose(6, 20_000)), (14, "ÄÖÜ ß éè 漢字 かな 🙂 " * 30), (14, "ÄÖÜ ß éè 漢字 かな 🙂 " * 30), (None, prose(7, 70)), (16, prose(7, 70)), (17, "a" * 5000),
    ]


def documents(spark, clash=True):
    rows = [(d, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), i, "x") for i, (d, t) in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans int, n_tokens string")
    return df if clash else df.drop("spans", "n_tokens")
