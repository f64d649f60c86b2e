"""Rerankers that weigh candidates with a language model over whole sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import BORDER, WORD, tokens
from .lexicon import base_score, top_k
from .morph import FUNCTION_WORDS
from .ngrams import BEGIN, END, OTHER

TOKEN = rf"{BORDER}[{WORD}-]+{BORDER}"
AGREEING = ("nomn", "gent", "datv", "accs", "ablt", "loct")

#: Options of a case: for each position the original and its candidates with base scores.
OPTIONS = "array<array<struct<term:string,base:double>>>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def recombine(text: Column, tokens: Column) -> Column:
    """``text`` with its words replaced, one after the other, by ``tokens``."""
    between = F.split(F.regexp_replace(text, TOKEN, "\u0001"), "\u0001", -1)
    return F.concat_ws("", F.flatten(F.zip_with(between, tokens, lambda b, t: F.array(b, F.coalesce(t, F.lit(""))))))


def options(cases: DataFrame, terms: DataFrame, k: int = 5, distance: int = 2, id: str = "case_id", text: str = "text") -> DataFrame:
    """``id``, text, and for each word its candidates: found (array of arrays of (term, base), best first), and the original alone.

    Candidates are looked up once for each different word.
    """
    rows = cases.select(id, F.posexplode(words(F.col(text))).alias("pos", "token"))
    best = top_k(rows.select("token"), terms, k, distance).select(F.col("token").alias("_t"), F.struct("position", "term", base_score(F.col("distance"), F.col("position")).alias("base")).alias("c"))
    lists = best.groupBy("_t").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    per = rows.join(lists, F.col("token") == F.col("_t"), "left").select(id, "pos", "token", F.coalesce(F.transform("cs", lambda c: F.struct(c["term"].alias("term"), c["base"].alias("base"))), F.expr("cast(array() as array<struct<term:string,base:double>>)")).alias("cs"))
    grouped = per.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "cs"))).alias("_all"))
    out = cases.select(id, text).join(grouped.withColumnRenamed(id, "_id"), F.col(id) == F.col("_id"), "left")
    return out.select(id, text, F.coalesce(F.transform("_all", lambda x: x["token"]), F.expr("cast(array() as array<string>)")).alias("tokens"), F.coalesce(F.transform("_all", lambda x: x["cs"]), F.expr(f"cast(array() as {OPTIONS})")).alias("found"))


class Bigrams:
    """The probabilities that a case needs, from its own model rows."""

    def __init__(self, uni: dict[str, tuple[float, float]], bi: dict[tuple[str, str], float]):
        self.uni, self.bi = uni, bi

    def step(self, left: str, right: str) -> float:
        if (p := self.bi.get((left, right))) is not None:
            return p
        other = self.uni[OTHER]
        return self.uni.get(left, other)[1] + self.uni.get(right, other)[0]

    def sentence(self, tokens: list[str], end: bool) -> float:
        chain = [BEGIN, *tokens, *([END] if end else [])]
        return sum(self.step(a, b) for a, b in zip(chain, chain[1:], strict=False))


def pick(original: str, scored: list[tuple[str, float]], min_margin: float, min_abs: float) -> str:
    ranked = sorted(scored, key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] < min_abs or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < min_margin):
        return original
    return ranked[0][0]


def greedy(tokens: list[str], found: list[list[tuple[str, float]]], lm: Bigrams, min_margin: float, min_abs: float, alpha: float, beta: float) -> list[str]:
    """From left to right; what is chosen for a word is the context of the next ones."""
    now = list(tokens)
    for i, cs in enumerate(found):
        if cs:
            scored = [(t, alpha * b + beta * lm.sentence([*now[:i], t, *now[i + 1 :]], True)) for t, b in cs]
            now[i] = pick(now[i], scored, min_margin, min_abs)
    return now


def beam(tokens: list[str], found: list[list[tuple[str, float]]], lm: Bigrams, min_margin: float, min_abs: float, alpha: float, beta: float, width: int) -> tuple[list[str], float, float]:
    """The best way through all positions among ``width`` kept at each; only bigrams count, so a way's score grows step by step."""
    states: list[tuple[list[str], float, float]] = [([], 0.0, 0.0)]
    for token, cs in zip(tokens, found, strict=True):
        best = {token: 0.0}
        for term, base in cs:
            best[term] = max(best.get(term, base), base)
        ordered = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        grown = [([*way, t], base + b, lm_sum + lm.step(way[-1] if way else BEGIN, t)) for way, base, lm_sum in states for t, b in ordered]
        grown.sort(key=lambda s: -(alpha * s[1] + beta * s[2]))
        states = grown[: max(1, width)]
    done = sorted(((way, base, lm_sum + lm.step(way[-1] if way else BEGIN, END)) for way, base, lm_sum in states), key=lambda s: -(alpha * s[1] + beta * s[2]))
    value = [alpha * s[1] + beta * s[2] for s in done]
    way, base, lm_sum = done[0]
    passes = value[0] >= min_abs and (len(done) < 2 or value[0] - value[1] >= min_margin)
    return (way if passes else list(tokens)), base, lm_sum


def rerank(opts: DataFrame, uni: DataFrame, bi: DataFrame, min_margin: float, min_abs: float, alpha: float = 1.0, beta: float = 1.0, width: int = 4, id: str = "case_id", text: str = "text") -> DataFrame:
    """``id``, v1_output (greedy), v2_output (beam), v2_base_component, v2_kenlm_component and beam_changed_decision for ``options`` rows.

    Each case gets the model rows of its own words by joins, so the model is never on one machine; then cases are reranked in Arrow batches.
    """
    vocabulary = F.array_distinct(F.concat(F.array(F.lit(BEGIN), F.lit(END), F.lit(OTHER)), "tokens", F.flatten(F.transform("found", lambda cs: F.transform(cs, lambda c: c["term"])))))
    per = opts.select(id, F.explode(vocabulary).alias("w"))
    own_uni = per.join(uni.select("w", "logp", "backoff"), "w").groupBy(id).agg(F.collect_list(F.struct("w", "logp", "backoff")).alias("uni"))
    layers = F.transform(F.arrays_zip("tokens", "found"), lambda x: F.array_distinct(F.concat(F.array(x["tokens"]), F.transform(x["found"], lambda c: c["term"]))))
    chain = F.concat(F.array(F.array(F.lit(BEGIN))), layers, F.array(F.array(F.lit(END))))
    neighbours = F.zip_with(F.slice(chain, 1, F.size(chain) - 1), F.slice(chain, 2, F.size(chain) - 1), lambda a, b: F.flatten(F.transform(a, lambda l: F.transform(b, lambda r: F.struct(l.alias("l"), r.alias("r"))))))
    pairs = opts.select(id, F.explode(F.array_distinct(F.flatten(neighbours))).alias("p")).select(id, "p.l", "p.r")
    own_bi = pairs.join(bi.select("l", "r", "logp"), ["l", "r"]).groupBy(id).agg(F.collect_list(F.struct("l", "r", "logp")).alias("bi"))
    rows = opts.join(own_uni, id).join(own_bi, id, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens, found, u, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                lm = Bigrams({x["w"]: (x["logp"], x["backoff"]) for x in u}, {(x["l"], x["r"]): x["logp"] for x in b or ()})
                cs = [[(c["term"], c["base"]) for c in options] for options in found]
                out.append((greedy(tokens, cs, lm, min_margin, min_abs, alpha, beta), *beam(tokens, cs, lm, min_margin, min_abs, alpha, beta, width)))
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], t) for i, t in enumerate((words, words, pa.float64(), pa.float64())))], names=[id, text, "v1", "v2", "v2_base_component", "v2_kenlm_component"])

    kind = opts.schema[id].dataType.simpleString()
    done = rows.select(id, text, "tokens", "found", "uni", "bi").mapInArrow(run, f"`{id}` {kind}, `{text}` string, v1 array<string>, v2 array<string>, v2_base_component double, v2_kenlm_component double")
    v1, v2 = recombine(F.col(text), F.col("v1")), recombine(F.col(text), F.col("v2"))
    return done.select(id, v1.alias("v1_output"), v2.alias("v2_output"), "v2_base_component", "v2_kenlm_component", (v1 != v2).alias("beam_changed_decision"))


def neighbours(tokens: DataFrame, by: str = "case_id", order: str = "pos", token: str = "token") -> DataFrame:
    """``tokens`` with the words before and after (null at the ends)."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    return tokens.withColumns({"left": F.lag(token).over(w), "right": F.lead(token).over(w)})


def agreement(grammemes: Column, left: Column, right: Column) -> Column:
    """0.15 for each neighbour that shares number, and for each that shares a case, 0.4 at most. Null readings give nothing."""
    shares = lambda n, names: F.coalesce(F.arrays_overlap(F.array_intersect(grammemes, F.array(*map(F.lit, names))), n), F.lit(False))
    gain = F.lit(0.0)
    for n in (left, right):
        for names in (("sing", "plur"), AGREEING):
            gain = gain + F.when(shares(n, names), 0.15).otherwise(0.0)
    return F.least(gain, F.lit(0.4))


def heuristic_score(token: Column, term: Column, rank: Column, distance: Column, a: Column, b: Column, gain: Column) -> Column:
    """Rank, distance, short words, and other parts of speech or lemmas cost; agreement with the neighbours is worth something.

    ``a`` and ``b``: readings (pos, lemma, variants) of the token and the term; null fields cost nothing.
    """
    cost = lambda test, c: F.when(F.coalesce(test, F.lit(False)), c).otherwise(0.0)
    return (
        1.0
        - 0.35 * rank
        - 0.30 * distance
        - cost((F.length(token) <= 3) | (F.length(term) <= 3), 0.35)
        - cost(F.coalesce(a["pos"].isin(*FUNCTION_WORDS), F.lit(False)) | F.coalesce(b["pos"].isin(*FUNCTION_WORDS), F.lit(False)), 0.45)
        - cost(a["pos"] != b["pos"], 0.35)
        - cost(a["lemma"] != b["lemma"], 0.20)
        - cost(F.coalesce(b["variants"], F.lit(0)) > F.coalesce(a["variants"], F.lit(0)) + 2, 0.15)
        + gain
    )


def heuristic_replay(cases: DataFrame, dictionary: DataFrame, morph: DataFrame | None = None, id: str = "case_id", text: str = "text", k: int = 3, distance: int = 1, margin: float = 0.20, least: float = 0.05, buffer: int = 1) -> DataFrame:
    """``id``, output and the counts generated, applied, not_applied and ambiguous: candidates of safe words, weighed with their neighbours.

    Zones are masked. A word's candidates are the closest terms of ``dictionary`` (term, rank), the best ``k``; the best score must be
    ``least`` at least and lead by ``margin``. Plural drops, what the morphological guard blocks, and words within ``buffer`` of
    a zone stay. ``morph`` as in ``morph.decisions``; without it words have no readings. Candidates are looked up once for each different word.
    """
    from pyspark.sql import Window

    from ..functions import zones
    from . import spelling
    from .candidates import closest, within
    from .morph import guarded

    masked = cases.select(id, F.coalesce(F.col(text), F.lit("")).alias("_raw")).withColumn("_zones", zones.zones(F.col("_raw")))
    masked = masked.withColumns({"_values": zones.originals(F.col("_raw"), F.col("_zones")), "_text": zones.mask(F.col("_raw"), F.col("_zones"))})
    masked = masked.withColumns({"_words": tokens(F.col("_text"), 2), "_holes": zones.placeholder_spans(F.col("_text"))})
    word = masked.select(id, "_text", "_words", "_holes", F.posexplode("_words").alias("pos", "w"))
    at = lambda shift: F.try_element_at(F.col("_words"), F.col("pos") + shift)["value"]
    word = word.select(
        id, "pos", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.value").alias("token"),
        F.when(F.col("pos") > 0, F.get(F.col("_words"), F.col("pos") - 1)["value"]).alias("left"), at(2).alias("right"),
        spelling.wrapped(F.col("_text"), F.col("w.start"), F.col("w.end"), ("@", "#")).alias("wrapped"),
        F.exists("_holes", lambda z: (F.col("w.start") < z["end"] + buffer) & (F.col("w.end") > z["start"] - buffer)).alias("blocked"),
    ).where(spelling.safe_token(F.col("token")) & ~F.col("wrapped"))
    rank = Window.partitionBy("token").orderBy("distance", "rank")
    found = closest(within(word.select("token"), dictionary, distance)).withColumn("base_rank", F.row_number().over(rank) - 1)
    found = found.where((F.col("term") != F.col("token")) & spelling.safe_candidate(F.col("term")))
    found = found.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") <= k).select(F.col("token").alias("_t"), "term", "distance", "base_rank")
    rows = word.join(found, F.col("token") == F.col("_t"))
    reading = "pos string, lemma string, grammemes array<string>, variants int"
    if morph is None:
        for name in ("a", "b", "l", "r"):
            rows = rows.withColumn(f"_{name}", F.expr(f"cast(null as struct<{reading.replace(' ', ':').replace(',:', ',')}>)"))
    else:
        first = morph.groupBy("form").agg(F.max_by(F.struct("pos", "lemma", "grammemes"), "score").alias("f"), F.count(F.lit(1)).cast("int").alias("n"))
        first = first.select("form", F.struct("f.pos", "f.lemma", "f.grammemes", F.col("n").alias("variants")).alias("x"))
        for name, key in (("a", "token"), ("b", "term"), ("l", "left"), ("r", "right")):
            one = first.select(F.col("form").alias(f"_f{name}"), F.col("x").alias(f"_{name}"))
            rows = rows.join(one, F.col(key) == F.col(f"_f{name}"), "left").drop(f"_f{name}")
    gain = agreement(F.col("_b.grammemes"), F.col("_l.grammemes"), F.col("_r.grammemes"))
    rows = rows.withColumn("score", heuristic_score(F.col("token"), F.col("term"), F.col("base_rank"), F.col("distance"), F.col("_a"), F.col("_b"), gain))
    best = Window.partitionBy(id, "pos").orderBy(F.desc("score"), "distance", "base_rank", "term")
    ranked = rows.withColumns({"_r": F.row_number().over(best), "_next": F.lead("score").over(best)}).where("_r = 1")
    lead = F.col("score") - F.coalesce("_next", F.lit(-999.0))
    stays = F.coalesce(guarded(F.col("token"), F.col("term"), F.col("_a"), F.col("_b")) & F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(False))
    use = (F.col("score") >= least) & (lead >= margin) & ~spelling.plural_drop(F.col("token"), F.col("term")) & ~stays & ~F.col("blocked")
    per = ranked.groupBy(id).agg(
        F.count(F.lit(1)).alias("generated"), F.count_if(use).alias("applied"), F.count_if(~use).alias("not_applied"), F.count_if(lead < margin).alias("ambiguous"),
        F.array_sort(F.collect_list(F.when(use, spelling.edit(F.col("start"), F.col("end"), F.col("token"), F.col("term"))))).alias("_edits"),
    ).withColumnRenamed(id, "_id")
    out = masked.join(per, F.col(id) == F.col("_id"), "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    done = spelling.apply_edits(F.col("_text"), F.coalesce("_edits", F.expr(spelling.NONE)), none, 0, True)["text"]
    return out.select(id, zones.restore(done, F.col("_values")).alias("output"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("generated", "applied", "not_applied", "ambiguous")])
