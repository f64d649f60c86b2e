"""Protected zones: find them, merge them, put placeholders in their place, and put them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import BLANK, DIGIT, SPAN, WORD, let, spans

_D, _HEX = DIGIT, "[0-9a-fA-F]"
#: A word border before a character that is looked at first, as most places fail there; and one after a word character.
_BEFORE, _AFTER = rf"(?<![{WORD}])", rf"(?![{WORD}])"

#: What the zones are; the order decides between labels of equal spans. Fixed values.
PATTERNS: dict[str, str] = {
    "url": rf"[hH][tT][tT][pP][sS\u017F]?://[^{BLANK}]+",
    "email": rf"[{WORD}.+-]++@[{WORD}-]+\.[{WORD}.-]+",
    "phone": rf"\+?{_D}[{_D}{BLANK}().-]{{6,}}{_D}",
    "date": rf"(?={_D}){_BEFORE}(?:{_D}{{2}}[./-]{_D}{{2}}[./-]{_D}{{4}}{_AFTER}|{_D}{{4}}-{_D}{{2}}-{_D}{{2}}{_AFTER})",
    "time": rf"(?={_D}){_BEFORE}{_D}{{1,2}}:{_D}{{2}}{_AFTER}",
    "number": rf"(?={_D}){_BEFORE}{_D}[{_D}{BLANK},.-]*{_D}{_AFTER}",
    "uuid": rf"(?={_HEX}){_BEFORE}{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}{_AFTER}",
    "ticket": rf"(?=[A-Z]){_BEFORE}[A-Z]{{2,10}}-{_D}{{1,6}}{_AFTER}",
    "path": rf"(?:(?=[A-Za-z]:\\){_BEFORE}[A-Za-z]:\\|(?=/)(?<=[{WORD}])/)[^{BLANK}]+",
    "command": rf"(?=[sgdkp]){_BEFORE}(?:sudo|git|docker|kubectl|python|pip){_AFTER}[^\n]*",
    "code": rf'```[\s\S]*?```|<code>[\s\S]*?</code>|\{{[{BLANK}]*"[^"]+"[{BLANK}]*:[{BLANK}]*[^}}]+\}}',
}


def _possible(text: Column, label: str) -> Column:
    """A cheap test that every text with such a zone passes."""
    if label in ("phone", "date", "time", "number"):
        return text.rlike(_D)
    marks = {"url": ("://",), "email": ("@",), "uuid": ("-",), "ticket": ("-",), "path": ("/", ":\\"), "code": ("```", "<code>", "{"), "command": ("sudo", "git", "docker", "kubectl", "python", "pip")}[label]
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


PLACEHOLDER = rf"⟦PZ{_D}+⟧"
ZONE = "array<struct<start:int,end:int,label:string>>"


def raw_spans(text: Column, labels: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """Matches of all patterns in the order of start, end and pattern: array of (start, end, ord, label)."""
    def labelled(label: str) -> Column:
        place = list(PATTERNS).index(label)
        none = F.expr("cast(array() as array<struct<start:int,end:int,ord:int,label:string>>)")
        found = F.transform(spans(text, PATTERNS[label]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(place).alias("ord"), F.lit(label).alias("label")))
        return F.when(_possible(text, label), found).otherwise(none)

    found = [labelled(k) for k in labels]
    return F.array_sort(F.concat(*found))


def merged(raw: Column) -> Column:
    """Spans that overlap or touch become one, with the label of the first: array of (start, end, label)."""
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        return F.when(s["start"] <= last["end"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(one(s))))

    return F.aggregate(raw, F.expr(f"cast(array() as {ZONE})"), step)


def zones(text: Column) -> Column:
    return merged(raw_spans(text))


def originals(text: Column, found: Column) -> Column:
    """The zones' own texts, in order; zone i has the placeholder i."""
    return let(text, lambda t: F.transform(found, lambda z: t.substr(z["start"] + 1, z["end"] - z["start"])))


def placeholder(index: Column) -> Column:
    return F.concat(F.lit("⟦PZ"), index.cast("string"), F.lit("⟧"))


def mask(text: Column, found: Column) -> Column:
    """``text`` with placeholders in place of its zones."""
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit("").alias("out"))

    def masked(t: Column) -> Column:
        def step(acc: Column, z: Column) -> Column:
            before = t.substr(acc["at"] + 1, z["start"] - acc["at"])
            return F.struct(z["end"].alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], before, placeholder(acc["i"])).alias("out"))

        return F.aggregate(found, state, step, lambda acc: F.concat(acc["out"], t.substr(acc["at"] + 1, F.length(t))))

    return let(text, masked)


def _numbered(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(placeholder(i).alias("key"), v.alias("value")))


def restore(text: Column, values: Column) -> Column:
    """Every placeholder replaced by its zone's text, one zone after the other."""
    return F.aggregate(_numbered(values), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def intact(text: Column, values: Column) -> Column:
    """Whether each placeholder still stands in ``text``."""
    return let(text, lambda t: F.forall(_numbered(values), lambda e: F.contains(t, e["key"])))


def count_placeholders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLACEHOLDER))


def placeholder_spans(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("⟦PZ")), spans(text, PLACEHOLDER)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def all_restored(text: Column, values: Column) -> Column:
    """Whether each zone's text can be taken from ``text``, one after the other, each use once."""
    state = F.struct(F.lit(True).alias("ok"), text.alias("rest"))

    def step(acc: Column, e: Column) -> Column:
        def at(k: Column) -> Column:
            cut = F.concat(acc["rest"].substr(F.lit(1), k - 1), e["key"], acc["rest"].substr(k + F.length(e["value"]), F.length(acc["rest"])))
            return F.struct((acc["ok"] & (k > 0)).alias("ok"), F.when(k > 0, cut).otherwise(acc["rest"]).alias("rest"))

        return let(F.position(e["value"], acc["rest"]), at)

    return F.aggregate(_numbered(values), state, step, lambda acc: acc["ok"])


def still_detected(text: Column, values: Column) -> Column:
    """Whether the zones found in ``text`` hold each expected text at least as often as it is expected."""
    times = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    both = F.struct(let(text, lambda t: originals(t, zones(t))).alias("now"), values.alias("want"))
    enough = let(both, lambda b: F.forall(F.array_distinct(b["want"]), lambda v: times(b["now"], v) >= times(b["want"], v)))
    return F.when(F.size(values) == 0, F.lit(True)).otherwise(enough)
