"""Small tables with the cases that operators must handle, and brute-force versions of the operators."""

import random
import re

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents():
    """Copies, near copies in chains, shared passages, nulls, empty and very long texts, repeated rows, null ids."""
    rng = random.Random(5)
    rows = []
    passage = words(rng, 60)
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 300)), rng.choice(["en", "de", None]), "s", 1))
    base = words(rng, 200).split()
    for i in range(60, 90):  # each a few words from the one before
        for _ in range(2):
            base[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(base), "en", "s", 2))
    for i in range(90, 100):
        rows.append((i, f"{words(rng, rng.randrange(0, 40))} {passage} {words(rng, rng.randrange(0, 40))}", "en", "t", 3))
    for i in range(100, 106):
        rows.append((i, rows[3][1], "en", "t", 4))
    rows += [(106, None, None, None, None), (107, "", "en", None, 0), (108, " \t\n", "en", "u", 3), (109, "one", "en", "u", 3), (110, "ONE", "en", "u", 3)]
    rows += [(111, "é" * 700 + "ß", "de", "u", 3), (112, "x" + "é" * 700, "de", "u", 3), (113, words(rng, 20000), "en", "long", 5), (114, "a" * 900, "en", "u", 1)]
    rows += [(None, rows[5][1], "en", "u", 1), (None, None, None, None, None), (7, rows[7][1], "en", "again", 1), (8, "another text of the same id", "en", "u", 1)]
    rows += [(115, "line one\nline two\nline one\n\n" + "to be or not to be that is " * 3, "en", "u", 1)]
    return rows


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


def thue_morse(n):
    """Two different words over a and b of 2**n letters that every polynomial hash modulo a power of two confuses."""
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def clashing(docs, *names):
    """``docs`` with more columns, of names that an operator might use itself."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit(f"other {n}") for n in names})


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
