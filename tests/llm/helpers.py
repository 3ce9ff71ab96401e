"""Brute-force versions and small corpora for the operators' tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(ids, links):
    """Smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def prose(rng, n, letters="abcdefghijklmnop"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def corpus(seed=11):
    """Prose with copies, near copies, a shared passage, odd texts, a null text, a null id and repeated rows."""
    rng = random.Random(seed)
    rows = [(i, " ".join(prose(rng, rng.randint(3, 160)))) for i in range(40)]
    shared = " ".join(prose(rng, 60))
    rows += [(100 + i, f"{' '.join(prose(rng, 90))} {shared} {' '.join(prose(rng, 20))}") for i in range(12)]
    base = prose(rng, 120)
    for i in range(25):  # near copies of one text, some too far from each other to be linked
        near = list(base)
        for _ in range(i % 6):
            near[rng.randrange(len(near))] = "changed"
        rows.append((200 + i, " ".join(near)))
    rows += [(300 + i, rows[3][1]) for i in range(20)] + [(320, rows[3][1].upper())]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "one"), (404, "ONE"), (405, "one two three four"),
             (406, "x " * 3000), (407, "ünï©ode wörds"), (None, "a text without an id of its own here")]
    return rows + rows[:3]


def frame(spark, rows, columns="doc_id long, text string"):
    """With extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, columns)
    return df.withColumns({"id": F.lit("x"), "n": F.lit(1.5), "h": F.lit(None).cast("string"), "label_": F.lit(True),
                           "score": F.lit("s"), "part": F.lit(0), "start": F.lit("begin"), "row": F.lit(2),
                           "text_hash": F.lit("t"), "found_spans": F.lit(0), "added": F.lit("a"), "leaks": F.lit(1),
                           "base_spans": F.lit("b"), "all_spans": F.lit("c"), "words": F.lit(0), "held": F.lit(0)})
