"""Documents with everything that can be odd, and slow but plain versions of what operators do."""

from collections import defaultdict

import regex
from pyspark.sql import functions as F

ALONE = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}"
LETTERS = r"\p{Alphabetic}\p{M}\p{N}_\u200c\u200d"
WORD = regex.compile(f"[{ALONE}&&[{LETTERS}]]|(?:(?![{ALONE}])[{LETTERS}])+", regex.V1)
#: Names that operators use inside, or that differ from those in case alone.
CLASHING = ["id", "key", "hash", "value", "digest", "seeds", "n", "rank", "seed", "print", "component", "node", "k", "g", "row", "lost", "__source", "__lost", "__digest", "__k", "a.b", "place", "rate", "score"]


def lower(text):
    return "".join(c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c for c in text)


def words(text):
    return [(lower(m.group()), m.start(), m.end()) for m in WORD.finditer(text or "")]


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "de", "ki", "lo", "mu", "ra", "te"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_rows():
    long = prose(99, 40_000)
    return [
        (1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, ""), (4, ""), (5, None), (6, None), (None, prose(1, 120)), (None, None), (7, long), (8, long), (9, "x" * 50_000),
        (10, "\n\n \t"), (11, "日本語 テキスト 😀"), (12, "one"), (13, prose(2, 60) + "\n" + prose(3, 10)), (14, prose(3, 10) + "\n" + prose(4, 60)), (15, "a\x00b"), (16, prose(1, 120).upper()),
    ]


def odd_docs(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    base = spark.createDataFrame(rows, "doc_id bigint, text string")
    return base.select("*", F.lit(None).cast("string").alias("lang"), *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def connected(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeated_passages(texts, least):
    """{(id, start word, words, start char, end char)} of maximal runs of words whose every window others have too."""
    own = {i: words(t) for i, t in texts.items()}
    seen = defaultdict(set)
    for i, w in own.items():
        for a in range(len(w) - least + 1):
            seen[tuple(x[0] for x in w[a : a + least])].add(i)
    out = set()
    for i, w in own.items():
        run = None
        for a in range(len(w) - least + 2):
            if a <= len(w) - least and seen[tuple(x[0] for x in w[a : a + least])] - {i}:
                run, last = (a if run is None else run), a
            elif run is not None:
                out.add((i, run, last + least - run, w[run][1], w[last + least - 1][2]))
                run = None
    return out
