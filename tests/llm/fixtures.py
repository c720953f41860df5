"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, n string, part string, value int"


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = words(60), words(80)
    texts = [None, "", " \n\t", "a", "A", "a b", "Über straße 中文 😀", "x " * 300, " ".join(words(6000)), "nul\x00 byte", "word" * 2000]
    for _ in range(n):
        texts.append(" ".join(words(rng.randint(0, 120))))
        texts.append(" ".join(words(5) + passage[rng.randint(0, 20) :] + words(rng.randint(0, 9))))
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = f"edit{rng.random()}"
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 7 + [" ".join(passage)] * 3
    out = [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", None]), len(t or ""), 1, "k", "n", "p", 2) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


def frame(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA).repartition(4)
