"""Spelling edits of a text: tokens, guards, typo maps and suggestions, as array expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import WORD, beside, char_at, let, placed, replaced, spans, splice, token_parts

#: Letters of the corrected alphabet; tokens with any other character are left alone.
LETTERS = "а-яё"

#: Frequent misspellings with one right form, used before candidates are generated. Fixed values.
SAFE_TOKENS = {
    "делему": "дилемму",
    "охото": "охота",
    "отделного": "отдельного",
    "замечательнх": "замечательных",
    "конкурентнсть": "конкурентность",
    "граммотно": "грамотно",
    "репресии": "репрессии",
    "существовует": "существует",
    "съэкономить": "сэкономить",
    "приемлимо": "приемлемо",
    "интерентом": "интернетом",
    "наоброт": "наоборот",
    "сумашедший": "сумасшедший",
    "необходмо": "необходимо",
    "благодвря": "благодаря",
    "соответсвует": "соответствует",
    "дейстительно": "действительно",
    "колличеству": "количеству",
    "компьтер": "компьютер",
    "паступят": "поступят",
}

#: A vowel that never follows these consonants, and the one that is written. Fixed values.
AFTER_HUSHING = {"ы": ("и", "жш"), "я": ("а", "чщж"), "ю": ("у", "чщжш")}

EDIT = "array<struct<start:int,end:int,before:string,after:string>>"
NONE = f"cast(array() as {EDIT})"


def digraphs() -> dict[str, str]:
    """Wrong pairs to right ones, in lower, title and upper case."""
    lower = {c + wrong: c + right for wrong, (right, before) in AFTER_HUSHING.items() for c in before}
    return {form(k): form(v) for k, v in lower.items() for form in (str, str.title, str.upper)}


def literal_map(entries: dict[str, str]) -> Column:
    if not entries:
        return F.expr("cast(map() as map<string,string>)")
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def edit(start: Column, end: Column, before: Column, after: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), before.alias("before"), after.alias("after"))


def digraph_edits(text: Column) -> Column:
    """Edits of hushing pairs anywhere in words; pairs never overlap, for they begin with a consonant and end with a vowel."""
    rules = digraphs()
    found = F.transform(spans(text, "|".join(sorted(rules))), lambda s: edit(s["start"], s["end"], s["value"], F.element_at(literal_map(rules), s["value"])))
    return F.when(text.rlike("[ЖШЧЩжшчщ]"), found).otherwise(F.expr(NONE))


def safe_token(token: Column, letters: str = LETTERS) -> Column:
    """Lower-case letters of the alphabet only: no hyphen, digit, capital or other script."""
    return token.rlike(rf"\A[{letters}]+\z")


def safe_candidate(token: Column, letters: str = LETTERS) -> Column:
    """As ``safe_token``, with single hyphens between letters."""
    return token.rlike(rf"\A[{letters}]+(-[{letters}]+)*\z")


def wrapped(text: Column, start: Column, end: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a token stands in brackets, quotes or slashes, is glued to a key, or follows a prefix that says not to touch it."""
    return _wrapped(char_at(text, start - 2), char_at(text, start - 1), char_at(text, end), prefixes)


def _wrapped(two: Column, before: Column, after: Column, prefixes: tuple[str, ...]) -> Column:
    pair = ((before == "(") & (after == ")")) | (before.isin('"', "'") & (after == before)) | ((before == "/") & (after == "/"))
    glued = before.isin(":", "_") & two.rlike(f"[{WORD}]")
    return pair | glued | (before.isin(*prefixes) if prefixes else F.lit(False))


def plural_drop(token: Column, candidate: Column) -> Column:
    """Whether the candidate only takes a plural ending off."""
    return (F.length(token) >= 4) & token.rlike("[ыи]$") & (candidate == token.substr(F.lit(1), F.length(token) - 1))


def eligible(text: Column, least: int, untouched: frozenset[str], prefixes: tuple[str, ...], letters: str = LETTERS, only: Collection[str] | None = None) -> Column:
    """Tokens that may be corrected: array of (start, end, value). ``only``: those of a few words; no others are edited where all that
    is wanted are the edits of a typo map.
    """

    def found(parts: Column) -> Column:
        def keep(t: Column, i: Column) -> Column:
            ok = safe_token(t["value"], letters)
            ok = ok & ~t["value"].isin(*sorted(untouched)) if untouched else ok
            return ok & let(beside(parts, i), lambda x: ~_wrapped(x["two"], x["before"], x["after"], prefixes))

        return F.filter(placed(parts), keep)

    return F.when(text.rlike(f"[{letters}]"), let(token_parts(text, least, only), found)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def outcomes(found: Column, typo_map: dict[str, str], suggestions: Column | None, shadow: bool, letters: str = LETTERS, gate: dict[str, str] | None = None) -> Column:
    """What becomes of each eligible token: array of (start, end, before, after, source, reason, morph).

    Sources in order: the typo map, the safe tokens (only with candidates), a suggestion, which is a map from token to (status, term,
    morph). Reasons: apply, none, same, unsafe, no_result, ambiguous, plural_drop, guard, morph_blocked, morph_unknown, shadow.
    The morphological decision is about the token and what replaces it: ``gate`` has it for each token of the maps (None: no gate), a
    suggestion brings its own.
    """
    maps = literal_map(typo_map)
    safe = literal_map(SAFE_TOKENS if suggestions is not None else {})
    judged_pairs = literal_map(gate or {})

    def after(token: Column, hint: Column | None, listed: Column) -> Column:
        status = F.coalesce(hint["status"], F.lit("rejected")) if hint is not None else F.lit("none")
        term = F.coalesce(listed, F.when(status == "generated", hint["term"])) if hint is not None else listed
        own = F.when(listed.isNotNull(), judged_pairs[token])
        morph = F.when(listed.isNull(), hint["morph"]).otherwise(own) if hint is not None else own
        return F.struct(status.alias("status"), term.alias("term"), listed.isNull().alias("generated"), morph.alias("morph"))

    def one(t: Column) -> Column:
        token = t["value"]
        listed = F.coalesce(F.nullif(maps[token], F.lit("")), safe[token])

        def judged(x: Column) -> Column:
            reason = (
                F.when(x["term"].isNull(), F.when(x["status"] == "ambiguous", "ambiguous").when(x["status"] == "rejected", "no_result").otherwise("none"))
                .when(x["term"] == token, "same")
                .when(~safe_candidate(x["term"], letters), "unsafe")
                .when(x["generated"] & plural_drop(token, x["term"]), "plural_drop")
                .when(x["generated"] & (x["morph"] == "guard"), "guard")
                .when(x["morph"] == "blocked", "morph_blocked")
                .when(x["morph"] == "unknown", "morph_unknown")
                .when(x["generated"] & F.lit(shadow), "shadow")
                .otherwise("apply")
            )
            return F.struct(t["start"].alias("start"), t["end"].alias("end"), token.alias("before"), x["term"].alias("after"), F.when(x["generated"], "generator").otherwise("map").alias("source"), reason.alias("reason"), x["morph"].alias("morph"))

        return let(after(token, suggestions[token] if suggestions is not None else None, listed), judged)

    return F.transform(found, one)


def edits(results: Column) -> Column:
    return F.transform(F.filter(results, lambda r: r["reason"] == "apply"), lambda r: edit(r["start"], r["end"], r["before"], r["after"]))


def counters(results: Column) -> dict[str, Column]:
    """Counts of the exits, as they are reported for a text."""
    n = lambda *reasons: F.size(F.filter(results, lambda r: (r["source"] == "generator") & r["reason"].isin(*reasons)))
    every = lambda reason: F.size(F.filter(results, lambda r: r["reason"] == reason))
    return {
        "candidate_generated_count": n("unsafe", "guard", "morph_blocked", "morph_unknown", "shadow", "apply"),
        "candidate_applied_count": n("apply"),
        "candidate_rejected_count": n("no_result", "unsafe", "plural_drop", "guard", "morph_blocked", "morph_unknown"),
        "candidate_ambiguous_count": n("ambiguous"),
        "candidate_rejected_no_result_count": n("no_result", "plural_drop"),
        "candidate_rejected_unsafe_candidate_count": n("unsafe"),
        "candidate_rejected_morph_blocked_count": n("guard", "morph_blocked"),
        "candidate_rejected_morph_unknown_count": n("morph_unknown"),
        "candidate_ambiguous_tie_count": n("ambiguous"),
        "candidate_shadow_skipped_count": n("shadow"),
        "morph_blocked_count": every("morph_blocked"),
        "morph_allowed_count": F.size(F.filter(results, lambda r: r["reason"].isin("apply", "shadow") & (r["morph"] == "allowed"))),
        "morph_unknown_count": every("morph_unknown"),
    }


#: Edits that one fold puts into its array, which it copies with each.
_RUN = 64
_JUDGED = "array<struct<start:int,end:int,before:string,after:string,from:int,to:int,use:boolean>>"


def apply_edits(text: Column, wanted: Column, blocked: Column, buffer: int, skip_overlaps: bool) -> Column:
    """Edits applied from left to right: (text, shift, last, applied, rejected).

    An edit's place moves with what was applied before it. It is rejected if that place, widened by ``buffer``, meets one of the
    ``blocked`` spans, which are those of the text before any edit. ``skip_overlaps`` leaves out edits that begin before the last
    applied one ended; then all that are applied stand apart, and the text is built once and not with each edit.
    """
    state = lambda shift, last: F.struct(shift.alias("shift"), last.alias("last"), F.expr(f"cast(array() as {_JUDGED})").alias("out"))

    def fold(zones: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            def judged(p: Column) -> Column:
                near = F.exists(zones, lambda z: (p["start"] < z["end"] + buffer) & (p["end"] > z["start"] - buffer))
                skip = (e["start"] < acc["last"]) if skip_overlaps else F.lit(False)
                return let(F.struct(p.alias("p"), F.when(skip, "skip").when(near, "reject").otherwise("use").alias("what")), done)

            def done(x: Column) -> Column:
                p, use = x["p"], x["what"] == "use"
                moved = F.array(F.struct(p["start"].alias("start"), p["end"].alias("end"), e["before"].alias("before"), e["after"].alias("after"), e["start"].alias("from"), e["end"].alias("to"), use.alias("use")))
                return F.struct(
                    F.when(use, acc["shift"] + F.length(e["after"]) - F.length(e["before"])).otherwise(acc["shift"]).alias("shift"),
                    F.when(use, e["end"]).otherwise(acc["last"]).alias("last"),
                    F.when(x["what"] == "skip", acc["out"]).otherwise(F.concat(acc["out"], moved)).alias("out"),
                )

            return let(F.struct((e["start"] + acc["shift"]).alias("start"), (e["end"] + acc["shift"]).alias("end")), judged)

        def several(acc: Column, run: Column) -> Column:
            one = F.aggregate(run, state(acc["shift"], acc["last"]), step)
            return let(one, lambda x: F.struct(x["shift"].alias("shift"), x["last"].alias("last"), F.concat(acc["out"], x["out"]).alias("out")))

        runs = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _RUN).cast("int")), lambda k: F.slice(found, k * _RUN + 1, F.lit(_RUN)))
        begin = state(F.lit(0), F.lit(-1))
        return let(wanted, lambda found: F.when(F.size(found) <= _RUN, F.aggregate(found, begin, step)).otherwise(F.aggregate(runs(found), begin, several)))

    def built(x: Column) -> Column:
        used = F.filter(x["out"], lambda e: e["use"])
        spliced = let(used, lambda u: replaced(text, u)) if skip_overlaps else F.aggregate(used, text, lambda acc, e: splice(acc, e["start"], e["end"], e["after"]))
        plainly = lambda some: F.transform(some, lambda e: edit(e["start"], e["end"], e["before"], e["after"]))
        return F.when(
            x.isNotNull(),
            F.struct(F.when(x["shift"].isNotNull(), spliced).alias("text"), x["shift"].alias("shift"), x["last"].alias("last"), plainly(used).alias("applied"), plainly(F.filter(x["out"], lambda e: ~e["use"])).alias("rejected")),
        )

    return let(let(blocked, fold), built)
