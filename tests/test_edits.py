"""Tokens and edits of long texts, against plain Python written from their definitions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossarion.functions import regex, zones
from glossarion.operators import spelling

MAP = {"лес": "леса", "леса": "лес", "дом-дом": "дом", "кот": "", "ток": "токката", "ёж": "еж", "я": "мы"}
PIECES = ["лес", "леса", "лесам", "Лес", "кот", "ток", "ёж", "я", "дом", "-", "--", " ", " ", " ", "\n", ":", "_", "(", ")", '"', "'", "/", "#", "@", "a", "7", ".", "é", "😀", "\u0001", "⟦PZ0⟧", "⟦PZ12⟧"]


def texts(n, length, seed):
    dice = random.Random(seed)
    return ["".join(dice.choices(PIECES, k=dice.randrange(length + 1))) for _ in range(n)]


def brute_eligible(text, least, untouched, prefixes):
    at = lambda i: text[i] if 0 <= i < len(text) else ""
    for m in re.finditer(rf"\b[\w-]{{{least},}}\b", text):
        before, two, after = at(m.start() - 1), at(m.start() - 2), at(m.end())
        pair = (before, after) in [("(", ")"), ('"', '"'), ("'", "'"), ("/", "/")]
        glued = before in (":", "_") and re.match(r"\w", two)
        if re.fullmatch("[а-яё]+", m[0]) and m[0] not in untouched and not pair and not glued and (not before or before not in prefixes):
            yield m.start(), m.end(), m[0]


def brute_edits(text, wanted, blocked, buffer, skip):
    shift, last, applied, rejected = 0, -1, [], []
    for a, b, old, new in wanted:
        if skip and a < last:
            continue
        x, y = a + shift, b + shift
        if any(x < q + buffer and y > p - buffer for p, q in blocked):
            rejected.append((x, y, old, new))
            continue
        text, shift, last = text[:x] + new + text[y:], shift + len(new) - len(old), b
        applied.append((x, y, old, new))
    return text, shift, last, applied, rejected


def plainly(fold):
    return fold["text"], fold["shift"], fold["last"], [tuple(e) for e in fold["applied"]], [tuple(e) for e in fold["rejected"]]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_tokens_of_a_few_words_are_those_of_all_tokens(spark, least):
    t, listed = F.col("t"), set(MAP) | {"а.б", "-я", "лес|ток", ""}
    df = spark.createDataFrame([(x,) for x in [*texts(400, 40, least), *texts(20, 900, least), "", None]], "t string")
    untouched, prefixes = frozenset({"ток"}), ("#", "@")
    got = df.select("t", spelling.eligible(t, least, untouched, prefixes).alias("all"), spelling.eligible(t, least, untouched, prefixes, only=listed).alias("few"), spelling.eligible(t, least, untouched, prefixes, only=["а.б"]).alias("none")).collect()
    assert sum(len(r["few"]) for r in got) > 50
    for r in got:
        want = list(brute_eligible(r["t"] or "", least, untouched, prefixes))
        assert [tuple(x) for x in r["all"]] == want
        assert [tuple(x) for x in r["few"]] == [x for x in want if x[2] in listed] and r["none"] == []


@pytest.mark.parametrize("skip", [True, False])
def test_edits_of_texts_of_all_lengths(spark, skip):
    """Runs of edits and pieces of texts on both sides of the lengths at which they are cut; overlaps, blocked places, longer signs."""
    dice, rows = random.Random(int(skip)), []
    for n in [0, 1, 5, 1023, 1024, 1025, 2048, 2049, 9000] * 4:
        text = "".join(dice.choices("абвг 😀é", k=n))
        starts = sorted(dice.randrange(n + 1) for _ in range(dice.choice([0, 1, 63, 64, 65, 200])))
        sizes = [0, 1, 1, 3, 1500 if n > 5000 and dice.random() < 0.1 else 2]
        if not skip:  # places that overlap as those of punctuation do, so that none moves to before the text
            starts, sizes = sorted(set(starts)), [0, 1, 2]
        spans = [(a, min(a + dice.choice(sizes), n)) for a in starts]
        blocked = [(a, a + 4) for a in (dice.randrange(n + 1) for _ in range(3))] if n % 2 else []
        rows.append((text, [(a, b, text[a:b], dice.choice(["" if skip else "é", "я", "😀юю", text[a:b]])) for a, b in spans], [(a, b, "") for a, b in blocked]))
    df = spark.createDataFrame([*rows, (None, [], []), ("а", [], None)], f"t string, w {spelling.EDIT}, z {regex.SPAN}")
    got = df.select("t", "w", "z", spelling.apply_edits(F.col("t"), F.col("w"), F.col("z"), 1, skip).alias("f")).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert plainly(r["f"]) == brute_edits(r["t"], [tuple(e) for e in r["w"]], [(z["start"], z["end"]) for z in r["z"] or []], 1, skip)
    assert spark.createDataFrame([("а", None)], f"t string, w {spelling.EDIT}").select(spelling.apply_edits(F.col("t"), F.col("w"), F.expr(f"cast(array() as {regex.SPAN})"), 1, skip).alias("f")).first()["f"] is None


def mapped(text, only=None):
    wanted = spelling.edits(spelling.outcomes(spelling.eligible(text, 2, frozenset(), (), **({"only": only} if only else {})), MAP, None, False))
    return spelling.apply_edits(text, wanted, zones.placeholder_spans(text), 1, True)


def test_a_map_over_mixed_texts(spark):
    df = spark.createDataFrame([(x,) for x in [*texts(300, 60, 7), *texts(10, 3000, 8)]], "t string")
    for r in df.select("t", mapped(F.col("t")).alias("f"), mapped(F.col("t"), MAP).alias("g")).collect():
        wanted = [(a, b, v, MAP[v]) for a, b, v in brute_eligible(r["t"], 2, (), ()) if re.fullmatch("[а-яё]+", MAP.get(v, ""))]
        want = brute_edits(r["t"], wanted, [m.span() for m in re.finditer(r"⟦PZ\d+⟧", r["t"])], 1, True)
        assert plainly(r["f"]) == plainly(r["g"]) == want


def test_the_time_of_a_long_text_grows_with_its_length(spark):
    """A text of 30,000 words, 3,000 of them edited. Looked up from the text's beginning for each word, this took far longer."""
    text = " ".join("лес" if i % 10 == 0 else "словечко" for i in range(30_000))
    df = spark.createDataFrame([(text,)], "t string").select(mapped(F.col("t")).alias("f"))
    began = time.monotonic()
    fold = df.first()["f"]
    assert time.monotonic() - began < 15
    assert fold["text"] == re.sub(r"\bлес\b", "леса", text) and len(fold["applied"]) == 3_000
