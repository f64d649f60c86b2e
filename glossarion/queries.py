"""The registered queries of the cleaning and evaluation operators, each over its whole tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import regex, zones
from .operators import candidates, evaluation, lexicon, ngrams, punctuation, rerank, review, selector, spelling, stages
from .plans.clean import bounds, clean
from .sources.cases import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _values(spark: SparkSession, sql: str, ddl: str) -> DataFrame:
    """An inline relation, written as it stands in the oracle."""
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.sql(f"SELECT * FROM VALUES {sql} AS t({', '.join(names)})").select(*[F.col(n).cast(c.split(None, 1)[1]) for n, c in zip(names, ddl.split(", "), strict=True)])


# --- normalisation and strict cleaning ---

_NORM = """regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace({t}, chr(8203), ''), chr(160), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
 '[ \\t]+', ' ', 'g'), '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"""


@query("""SELECT lang, CASE WHEN text IS NULL OR length(regexp_replace(text, '\\s+', '', 'g')) = 0 THEN 'empty' WHEN length(text) > 20000 THEN 'too_long' ELSE 'ok' END AS status, count(*) AS n
FROM documents GROUP BY 1, 2""")
def text_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.groupBy("lang", bounds(F.col("text")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 'documents' AS tbl, doc_id AS id, CAST(0 AS BIGINT) AS turn, md5({_NORM.format(t="text")}) AS text_md5 FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, md5({_NORM.format(t="text")}) FROM conversations""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    talks = _read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("tbl"), F.col("conv_id").alias("id"), "turn", "text")
    return docs.union(talks).select("tbl", "id", "turn", F.md5(stages.normalized(F.col("text"))).alias("text_md5"))


@query(f"""SELECT doc_id, md5({_NORM.format(t="text")}) AS clean_md5, CAST(length({_NORM.format(t="text")}) AS BIGINT) AS n_chars, false AS rollback FROM documents""")
def strict_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(_read(spark, sf_dir, "documents").select("doc_id", "text"), "strict")
    return out.select("doc_id", F.md5("clean_text").alias("clean_md5"), F.length("clean_text").cast("long").alias("n_chars"), F.col("audit.rollback_applied").alias("rollback"))


@query(f"""SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE {_NORM.format(t="text")} <> text) AS changed FROM documents GROUP BY lang, source""")
def changed_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("lang", "source", "text", stages.normalized(F.col("text")).alias("clean"))
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("clean") != F.col("text")).alias("changed"))


# --- zones ---

_RE2 = {
    "url": r"(?i:https?)://[^\s]+",
    "email": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+",
    "phone": r"\+?[0-9][0-9\s().-]{6,}[0-9]",
    "time": r"\b[0-9]{1,2}:[0-9]{2}\b",
    "number": r"\b[0-9][0-9\s,.-]*[0-9]\b",
    "ticket": r"\b[A-Z]{2,10}-[0-9]{1,6}\b",
}


@query(f"SELECT doc_id, {', '.join(f"len(regexp_extract_all(text, '{p}')) AS n_{k}" for k, p in _RE2.items())} FROM documents")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(zones.PATTERNS[k])).cast("long").alias(f"n_{k}") for k in _RE2])


_ZOO = """(1, 'see https://example.org/a?b=1 now'), (2, 'mail a.b@mail.example.com, please'), (3, 'call +1 (555) 123-4567 today'), (4, 'due 2024-01-31 or 31.01.2024'),
(5, 'at 9:30 sharp'), (6, 'it is 1 234 567 units, 5 left'), (7, 'id 123E4567-e89b-12d3-a456-426614174000 ok'), (8, 'fix ABC-123 first'), (9, 'open C:\\\\temp\\\\x.txt here'),
(10, 'run git push origin main'), (11, 'use `x` and ```code here``` end'), (12, 'plain words only'), (13, '<code>a b</code> then {"k": 1}')"""


@query()
def zone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spans of one text of each kind; the tests compare them with a brute-force search."""
    zoo = _values(spark, _ZOO, "id int, text string")
    return zoo.select("id", F.explode(zones.raw_spans(F.col("text"))).alias("s")).select("id", "s.label", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(r"""WITH marked AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\b[0-9][0-9\s,.-]*[0-9]\b', chr(1) || '\0' || chr(2), 'g'), '[\x01\x02]') AS parts FROM documents),
parts AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM marked),
placed AS (SELECT doc_id, i, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(part) AS BIGINT) AS stop, part AS value FROM placed WHERE i % 2 = 0""")
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(regex.spans(F.col("text"), zones.PATTERNS["number"])).alias("s"))
    return found.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"), F.col("s.value").alias("value"))


@query(r"""WITH spans(id, a, b, ord, label) AS (VALUES (1, 0, 5, 0, 'url'), (1, 5, 9, 1, 'email'), (1, 12, 14, 2, 'phone'), (1, 12, 20, 5, 'number'), (1, 13, 15, 3, 'date'), (2, 3, 4, 0, 'url'), (2, 1, 2, 4, 'time')),
seen AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, b, ord) AS run FROM seen)
SELECT id, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS stop, arg_min(label, a * 1000000 + b * 100 + ord) AS label FROM runs GROUP BY id, run""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, "(1, 0, 5, 0, 'url'), (1, 5, 9, 1, 'email'), (1, 12, 14, 2, 'phone'), (1, 12, 20, 5, 'number'), (1, 13, 15, 3, 'date'), (2, 3, 4, 0, 'url'), (2, 1, 2, 4, 'time')", "id int, a int, b int, ord int, label string")
    packed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("end"), "ord", "label"))).alias("raw"))
    return packed.select("id", F.explode(zones.merged(F.col("raw"))).alias("z")).select("id", F.col("z.start").alias("start"), F.col("z.end").alias("stop"), F.col("z.label").alias("label"))


@query("SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS texts, CAST(0 AS BIGINT) AS failures")
def mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select("text").union(_read(spark, sf_dir, "pages").select("html"))
    found = texts.withColumn("z", zones.zones(F.col("text"))).withColumn("v", zones.originals(F.col("text"), F.col("z")))
    back = zones.restore(zones.mask(F.col("text"), F.col("z")), F.col("v"))
    return found.agg(F.count(F.lit(1)).alias("texts"), F.count_if(back != F.col("text")).alias("failures"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) AS t(id, contained)")
def zone_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether zones that were masked are found again in another text, each as often."""
    rows = _values(spark, "(1, 'call 12 and 12', 'now 12, then 12'), (2, 'call 12 and 12', 'only 12 here'), (3, 'no zone', 'at all'), (4, 'a@b.org', 'a at b.org')", "id int, before string, after string")
    values = zones.originals(F.col("before"), zones.zones(F.col("before")))
    return rows.select("id", zones.still_detected(F.col("after"), values).alias("contained"))


# --- punctuation and spelling ---


@query("SELECT doc_id, md5(regexp_replace(text, '([,.:;!?])([A-Za-zА-Яа-яЁё])', '\\1 \\2', 'g')) AS text_md5 FROM documents")
def space_after_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(punctuation.space_after(F.col("text"))).alias("text_md5"))


@query("SELECT doc_id, md5(regexp_replace(text, '[ \\t\\f\\v]+([,.:;!?])', '\\1', 'g')) AS text_md5 FROM documents")
def space_before_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(punctuation.space_before(F.col("text"))).alias("text_md5"))


@query("""WITH e(id, a, b) AS (VALUES (1, 0, 3), (2, 9, 10), (3, 15, 16), (4, 16, 18), (5, 30, 31)), z(a, b) AS (VALUES (10, 15), (29, 29))
SELECT id, a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM z WHERE e.a < z.b + 1 AND e.b > z.a - 1)""")
def edits_outside_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _values(spark, "(1, 0, 3), (2, 9, 10), (3, 15, 16), (4, 16, 18), (5, 30, 31)", "id int, a int, b int")
    found = _values(spark, "(10, 15), (29, 29)", "za int, zb int")
    return edits.join(found, (F.col("a") < F.col("zb") + 1) & (F.col("b") > F.col("za") - 1), "left_anti")


_TYPOS = {"превет": "привет", "какдила": "какдела"}
_TYPO_ROWS = "(1, 'превет мир'), (2, 'Превет мир'), (3, 'key:превет'), (4, '(превет)'), (5, 'превет-превет'), (6, 'превет превет'), (7, 'мир')"


@query("SELECT * FROM (VALUES (1, 'привет мир', 1), (2, 'Превет мир', 0), (3, 'key:превет', 0), (4, '(превет)', 0), (5, 'превет-превет', 0), (6, 'привет привет', 2), (7, 'мир', 0)) AS t(id, text, n_edits)")
def typo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    found = spelling.eligible(text, 4, frozenset(), ())
    wanted = spelling.edits(spelling.outcomes(found, _TYPOS, None, False))
    folded = spelling.apply_edits(text, wanted, zones.placeholder_spans(text), 1, True)
    return _values(spark, _TYPO_ROWS, "id int, text string").withColumn("f", folded).select("id", F.col("f.text").alias("text"), F.size("f.applied").alias("n_edits"))


@query("""WITH t(id, s) AS (VALUES (1, 'жызнь и ШЫНА'), (2, 'чяща, щюка'), (3, 'Жюри'), (4, 'жизнь'))
SELECT id, replace(replace(replace(replace(replace(replace(s, 'жы', 'жи'), 'ШЫ', 'ШИ'), 'чя', 'ча'), 'щя', 'ща'), 'щю', 'щу'), 'Жю', 'Жу') AS text FROM t""")
def digraph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, "(1, 'жызнь и ШЫНА'), (2, 'чяща, щюка'), (3, 'Жюри'), (4, 'жизнь')", "id int, text string")
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return rows.select("id", spelling.apply_edits(F.col("text"), spelling.digraph_edits(F.col("text")), none, 0, True)["text"].alias("text"))


@query()
def smart_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "smart")
    return out.select("doc_id", "lang", "clean_text", "audit.changed_ratio", "audit.rollback_applied", "audit.pz_spans_count", "audit.punctuation_fixes_count")


@query()
def rollback_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(_read(spark, sf_dir, "documents").select("text"), "smart")
    return out.select(F.explode("audit.rollback_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def audit_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean(_read(spark, sf_dir, "documents").select("lang", "text"), "smart").select("lang", "audit.*")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("pz_spans_count").alias("zones"), F.sum("punctuation_fixes_count").alias("fixes"), F.count_if("rollback_applied").alias("rollbacks"))


# --- vocabulary and candidates ---

_WORDS = "[a-z]+"


@query("SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 100")
def token_top_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{regex.WORD}]+"), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(100)


@query("""WITH t AS (SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w)
SELECT term, n, row_number() OVER (ORDER BY n DESC, term) - 1 AS rank FROM t""")
def ranked_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(_read(spark, sf_dir, "documents"), _WORDS).select("term", F.col("count").alias("n"), "rank")


#: A dictionary has the words that stand so often in the corpus.
FREQUENT = 50

_PAIRS = f"""WITH t AS (SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY w),
k AS (SELECT term, n, unnest(list_distinct(list_concat([term], list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1))))) AS key FROM t),
d AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) - 1 AS rank FROM t WHERE n >= {FREQUENT}),
pairs AS (SELECT DISTINCT a.term AS token, d.term AS term, d.rank AS rank FROM k a JOIN k b ON a.key = b.key JOIN d ON b.term = d.term),
near AS (SELECT token, term, rank, damerau_levenshtein(token, term) AS distance FROM pairs WHERE damerau_levenshtein(token, term) <= 1)"""


def _tokens_and_dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All words, and those that are frequent: ranks go by frequency, so these have the same ranks among themselves."""
    terms = vocabulary(_read(spark, sf_dir, "documents"), _WORDS)
    return terms.select(F.col("term").alias("token")), terms.where(F.col("count") >= FREQUENT)


@query(f"{_PAIRS} SELECT token, term, rank, CAST(distance AS INTEGER) AS distance FROM near")
def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, terms = _tokens_and_dictionary(spark, sf_dir)
    return candidates.within(tokens, terms, 1).select("token", "term", "rank", "distance")


@query(f"""{_PAIRS}, best AS (SELECT token, term, distance, row_number() OVER (PARTITION BY token ORDER BY distance, rank) AS r, count(*) OVER (PARTITION BY token, distance) AS same FROM near)
SELECT token, term, CAST(distance AS INTEGER) AS distance, same > 1 AS ambiguous FROM best WHERE r = 1""")
def best_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    tokens, terms = _tokens_and_dictionary(spark, sf_dir)
    near = candidates.within(tokens, terms, 1)
    order = Window.partitionBy("token").orderBy("distance", "rank")
    ranked = near.select("token", "term", "distance", F.row_number().over(order).alias("r"), (F.lead("distance").over(order) == F.col("distance")).alias("tie"))
    return ranked.where("r = 1").select("token", "term", "distance", F.coalesce("tie", F.lit(False)).alias("ambiguous"))


#: Whole words of all scripts, with the marks that follow letters.
_WHOLE = rf"[{regex.WORD}\p{{M}}]+"


@query(r"""WITH t AS (SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+')) AS w FROM documents) GROUP BY w)
SELECT term, n, row_number() OVER (ORDER BY n DESC, term) - 1 AS rank FROM t""")
def word_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ranked_vocabulary``, of whole words."""
    return vocabulary(_read(spark, sf_dir, "documents"), _WHOLE).select("term", F.col("count").alias("n"), "rank")


def _near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = vocabulary(_read(spark, sf_dir, "documents"), _WHOLE)
    return candidates.within(terms.select(F.col("term").alias("token")), terms, 1)


@query()
def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``near_terms``, of whole words and with all of them as the dictionary; DuckDB's edit distance counts bytes."""
    return _near_words(spark, sf_dir).select("token", "term", "rank", "distance")


@query()
def best_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best other word for each word: all are in the dictionary, so each would be its own best candidate. All are at one edit."""
    other = _near_words(spark, sf_dir).where("distance > 0")
    best = other.groupBy("token").agg(F.min(F.struct("distance", "rank", "term")).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.select("token", "b.term", "b.distance", (F.col("n") > 1).alias("ambiguous"))


@query()
def indel_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _values(spark, "('привт'), ('малоко'), ('карова'), ('превет')", "token string")
    terms = _values(spark, "('привет', 0), ('молоко', 1), ('корова', 2), ('совет', 3), ('карта', 4)", "term string, rank int")
    return candidates.suggest(tokens, terms, "rapidfuzz", 3, 1)


# --- language model ---

_CHAIN = """WITH s AS (SELECT {id} AS id, list_concat(['<s>'], list_concat(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}_]'), ['</s>'])) AS c FROM {table} WHERE len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]')) > 0)"""


@query(r"""WITH s AS (SELECT conv_id, turn, list_concat(['<s>'], list_concat(regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?'), ['</s>'])) AS c FROM conversations WHERE regexp_matches(text, '[\p{L}\p{N}_]')),
b AS (SELECT unnest(list_zip(c[:-2], c[2:])) AS p FROM s),
g AS (SELECT p[1] AS l, p[2] AS r, count(*) AS n FROM b GROUP BY 1, 2)
SELECT l, r, n FROM g""")
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.bigram_counts(_read(spark, sf_dir, "conversations")).select("l", "r", "n")


_LM = r"""WITH s AS (SELECT conv_id, turn, list_concat(['<s>'], list_concat(regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?'), ['</s>'])) AS c FROM conversations WHERE regexp_matches(text, '[\p{L}\p{N}_]')),
u0 AS (SELECT w, count(*) AS n FROM (SELECT unnest(c) AS w FROM s) GROUP BY w),
u AS (SELECT * FROM u0 UNION ALL SELECT '<unk>', 0 WHERE NOT EXISTS (SELECT 1 FROM u0 WHERE w = '<unk>')),
t AS (SELECT count(*) AS v, sum(n) AS t FROM u),
uni AS (SELECT w, n, log10((n + 1) / (t + v)) AS logp FROM u, t),
rows AS (SELECT conv_id, turn, unnest(list_zip(c[:-2], c[2:])) AS p FROM s),
g AS (SELECT p[1] AS l, p[2] AS r, count(*) AS n FROM rows GROUP BY 1, 2),
h AS (SELECT l, sum(n) AS n FROM g GROUP BY l),
bi AS (SELECT g.l, g.r, log10((g.n + 1) / (h.n + t.v)) AS logp FROM g JOIN h ON g.l = h.l, t)"""


@query(f"{_LM} SELECT w, n, round(logp, 6) AS logp FROM uni")
def unigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.train(_read(spark, sf_dir, "conversations"))[0].select("w", "n", F.round("logp", 6).alias("logp"))


_DOCUMENT_LM = _LM.replace("conv_id, turn", "doc_id").replace("conversations", "documents")


@query(f"{_DOCUMENT_LM} SELECT l, r, n FROM g")
def document_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bigrams``, over the documents."""
    return ngrams.bigram_counts(_read(spark, sf_dir, "documents")).select("l", "r", "n")


@query(f"{_DOCUMENT_LM} SELECT w, n, round(logp, 6) AS logp FROM uni")
def document_unigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``unigram_model``, trained on the documents."""
    return ngrams.train(_read(spark, sf_dir, "documents"))[0].select("w", "n", F.round("logp", 6).alias("logp"))


@query(f"{_DOCUMENT_LM} SELECT l, r, round(logp, 6) AS logp FROM bi")
def document_bigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed probabilities of the documents' word pairs."""
    return ngrams.train(_read(spark, sf_dir, "documents"))[1].select("l", "r", F.round("logp", 6).alias("logp"))


@query(f"{_LM} SELECT conv_id, turn, round(sum(bi.logp), 4) AS score FROM rows JOIN bi ON p[1] = bi.l AND p[2] = bi.r GROUP BY conv_id, turn")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the model that the same sentences train, so that every pair has been seen."""
    talks = _read(spark, sf_dir, "conversations")
    uni, bi = ngrams.train(talks)
    chain = ngrams.sentence(F.col("text"))
    rows = talks.where(F.size(chain) > 0).select("conv_id", "turn", F.slice(chain, 2, F.size(chain) - 2).alias("words"))
    return ngrams.score(rows, uni, bi, ["conv_id", "turn"], "words").select("conv_id", "turn", F.round("score", 4).alias("score"))


# --- selection and evaluation on conversations: an earlier turn is a case, its words are candidates ---

_CASES = """WITH c(case_id, original, expected, token, rank, score, pos) AS (VALUES
('a', 'x', 'y', 'y', 3, 0.9, 0), ('a', 'x', 'y', 'x', 0, 0.5, 1), ('b', 'x', 'x', 'y', 3, 0.2, 0), ('b', 'x', 'x', 'x', 0, 0.8, 1), ('c', 'p', 'q', 'q', 1, 0.51, 0), ('c', 'p', 'q', 'r', 2, 0.5, 1),
('d', 'm', 'n', 'n', 1, -0.5, 0), ('f', 'k', 'l', 'l', 1, 0.7, 0), ('f', 'k', 'l', 'j', 9, 0.7, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {score} DESC, pos) AS rn, lead({score}) OVER (PARTITION BY case_id ORDER BY {score} DESC, pos) AS nxt FROM c),
x AS (SELECT case_id, original, expected, token AS best, {score} AS top, nxt, CASE WHEN {score} < 0 THEN 'low_confidence' WHEN nxt IS NOT NULL AND {score} - nxt < 0.05 THEN 'low_margin' WHEN token = original THEN 'original_wins' ELSE 'apply_candidate' END AS reason FROM r WHERE rn = 1
 UNION ALL SELECT 'e', 'o', 'o', NULL, NULL, NULL, 'no_candidate')"""


def _cases(spark: SparkSession) -> DataFrame:
    rows = [("a", "x", "y", [("y", 3), ("x", 0)], {"y": 0.9, "x": 0.5}), ("b", "x", "x", [("y", 3), ("x", 0)], {"y": 0.2, "x": 0.8}), ("c", "p", "q", [("q", 1), ("r", 2)], {"q": 0.51, "r": 0.5}), ("d", "m", "n", [("n", 1)], {"n": -0.5}), ("e", "o", "o", [], {}), ("f", "k", "l", [("l", 1), ("j", 9)], {"l": 0.7, "j": 0.7})]
    return spark.createDataFrame(rows, "case_id string, original string, expected string, candidates array<struct<token:string,rank:int>>, scores map<string,double>")


def _decided(score: str) -> str:
    return _CASES.format(score=score)


@query(f"{_decided('score')} SELECT case_id, best, round(top, 6) AS best_score, reason, CASE WHEN reason = 'apply_candidate' THEN best ELSE original END AS selected FROM x")
def selector_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selector.replay(_cases(spark), "table", 0.0, 0.05).select("case_id", "best", F.round("best_score", 6).alias("best_score"), "reason", "selected")


@query(f"{_decided('score')} SELECT reason, count(*) AS n FROM x GROUP BY reason")
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selector.replay(_cases(spark), "table", 0.0, 0.05).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def ab_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark)
    return selector.compare(selector.replay(cases, "table", 0.0, 0.05), selector.replay(cases, "rank", 0.0, 0.05))


@query("""WITH a AS (SELECT b.item_id, string_split(b.text, ' ') AS l, string_split(c.text, ' ') AS r FROM benchmark b JOIN conversations c ON b.item_id = c.conv_id AND c.turn = 0),
n AS (SELECT item_id, l, r, unnest(range(greatest(len(l), len(r)))) AS position FROM a)
SELECT item_id, count(*) AS tokens, count(*) FILTER (WHERE l[position + 1] IS DISTINCT FROM r[position + 1]) AS different FROM n GROUP BY item_id""")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _read(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("said"))
    both = _read(spark, sf_dir, "benchmark").join(talks, F.col("item_id") == F.col("conv_id"))
    rows = evaluation.aligned(both, F.split("text", " "), F.split("said", " "), ["item_id"])
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(~F.col("left").eqNullSafe(F.col("right"))).alias("different"))


@query("SELECT conv_id, turn, lag(role) OVER w AS left_role, lead(role) OVER w AS right_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rerank.neighbours(rows, "conv_id", "turn", "role").select("conv_id", "turn", F.col("left").alias("left_role"), F.col("right").alias("right_role"))


@query("""WITH c(original, expected, candidate, score, second) AS (VALUES ('a', 'b', 'b', -1.0, -1.5), ('a', 'b', 'c', -2.0, -2.05), ('a', 'a', 'b', -0.5, NULL), ('d', 'e', 'e', -3.0, -9.0)),
g AS (SELECT a.v AS min_abs, m.v AS min_margin FROM (VALUES (-4.0), (-1.0)) a(v), (VALUES (0.0), (0.1), (1.0)) m(v)),
o AS (SELECT CAST(min_abs AS DOUBLE) AS min_abs, CAST(min_margin AS DOUBLE) AS min_margin, original, expected, CASE WHEN score >= min_abs AND (second IS NULL OR score - second >= min_margin) THEN candidate ELSE original END AS output FROM c, g)
SELECT min_abs, min_margin, count(*) AS total, count(*) FILTER (WHERE output = expected) AS exact, count(*) FILTER (WHERE output <> expected AND output <> original) AS wrong FROM o GROUP BY min_abs, min_margin""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, "('a', 'b', 'b', -1.0, -1.5), ('a', 'b', 'c', -2.0, -2.05), ('a', 'a', 'b', -0.5, NULL), ('d', 'e', 'e', -3.0, -9.0)", "original string, expected string, candidate string, score double, second double")
    return evaluation.sweep(rows, [-4.0, -1.0], [0.0, 0.1, 1.0])


@query("""WITH d AS (SELECT CASE WHEN length(text) > 20000 THEN 'too_long' WHEN text = upper(text) THEN 'capitals' ELSE 'other' END AS status, regexp_matches(text, '[0-9]') AS has_digit, contains(text, '@') AS has_at, contains(text, chr(10)) AS has_break FROM documents)
SELECT 'has_digit' AS noise, status, count(*) AS n FROM d WHERE has_digit GROUP BY status UNION ALL SELECT 'has_at', status, count(*) FROM d WHERE has_at GROUP BY status UNION ALL SELECT 'has_break', status, count(*) FROM d WHERE has_break GROUP BY status""")
def noise_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = _read(spark, sf_dir, "documents").select(F.when(F.length(t) > 20000, "too_long").when(t == F.upper(t), "capitals").otherwise("other").alias("status"), t.rlike("[0-9]").alias("has_digit"), F.contains(t, F.lit("@")).alias("has_at"), F.contains(t, F.lit("\n")).alias("has_break"))
    return evaluation.cross_tab(rows, ["has_digit", "has_at", "has_break"])


@query("""WITH r AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, lang, source FROM r WHERE rn <= 5""")
def examples_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return evaluation.examples(rows, "lang", ["doc_id"], 5).select("doc_id", "lang", "source")


@query()
def beam_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = spark.createDataFrame([("мама мыла раму",), ("мама мыла пол",), ("папа мыл раму",)], "text string")
    uni, bi = ngrams.train(corpus)
    terms = _values(spark, "('мама', 0), ('мыла', 1), ('раму', 2), ('папа', 3), ('рама', 4)", "term string, rank int")
    cases = _values(spark, "(1, 'мама мыла рамк'), (2, 'пама мыла раму!'), (3, 'ничего')", "case_id int, text string")
    opts = rerank.options(cases, terms)
    return rerank.rerank(opts, uni, bi, 0.1, -100.0)


@query()
def mode_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, "(1, 'слово ,слово', 'слово, слово'), (2, 'жызнь', 'жизнь'), (3, 'ok', 'ok')", "case_id int, input_text string, expected_clean_text string")
    runs = None
    for mode in ("strict", "smart"):
        one = evaluation.outcomes(clean(rows, mode, text="input_text")).withColumn("mode", F.lit(mode))
        runs = one if runs is None else runs.unionByName(one)
    return evaluation.mode_summary(runs, ["mode"])


@query("SELECT * FROM (VALUES ('wrong_change', CAST(2 AS BIGINT)), ('unchanged_when_expected_change + candidate_rejected_no_result', CAST(1 AS BIGINT)), ('mismatch_without_candidate_signal', CAST(1 AS BIGINT))) AS t(slice, count)")
def mismatch_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(
        spark,
        "(1, true, false, false, 0, 0, 0), (2, false, false, true, 0, 0, 0), (3, false, true, false, 0, 0, 1), (4, false, false, true, 0, 0, 0), (5, false, false, false, 0, 0, 0)",
        "case_id int, exact_match boolean, unchanged_when_expected_change boolean, wrong_change boolean, candidate_generated_count int, candidate_applied_count int, candidate_rejected_no_result_count int",
    )
    zero = ("candidate_ambiguous_count", "candidate_ambiguous_tie_count", "candidate_rejected_morph_blocked_count", "candidate_rejected_morph_unknown_count", "candidate_rejected_unsafe_candidate_count")
    return evaluation.slices(rows.withColumns({c: F.lit(0) for c in zero} | {"rollback_applied": F.lit(False)}))


@query("""WITH u AS (SELECT text AS input_text, 0 AS s, item_id AS pos FROM benchmark UNION ALL SELECT text, 1, doc_id FROM documents UNION ALL SELECT text, 2, conv_id * 1000000 + turn FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY input_text ORDER BY s, pos) AS rn FROM u) SELECT md5(input_text) AS text_md5, s AS origin, pos FROM r WHERE rn = 1""")
def union_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "benchmark").select(F.col("text").alias("input_text"), F.col("item_id").alias("pos"), F.lit(0).alias("origin"))
    b = _read(spark, sf_dir, "documents").select(F.col("text").alias("input_text"), F.col("doc_id").alias("pos"), F.lit(1).alias("origin"))
    c = _read(spark, sf_dir, "conversations").select(F.col("text").alias("input_text"), (F.col("conv_id") * 1000000 + F.col("turn")).alias("pos"), F.lit(2).alias("origin"))
    return review.union_first([a, b, c], ("input_text",)).select(F.md5("input_text").alias("text_md5"), "origin", "pos")


_ROLLOUT = "(1, 'not_ready', true, '', '', 'ok', 'ok'), (2, 'ready_for_review', true, '', '', 'ok', 'ok'), (3, 'ready_for_review', true, 'config_missing:x', '', 'ok', 'ok'), (4, 'review_needed', true, '', 'product_regression_not_run', 'ok', 'unknown'), (5, 'review_needed', false, '', '', 'ok', 'ok'), (6, 'ready_for_review', true, '', 'look', 'ok', 'ok'), (7, 'review_needed', true, '', '', 'ok', 'failed')"


@query(f"""WITH r(id, final, complete, warnings, review, config, regression) AS (VALUES {_ROLLOUT})
SELECT id, CASE WHEN final = 'not_ready' OR config = 'fail' OR regression = 'failed' OR warnings LIKE 'config_missing%' OR NOT complete THEN 'hold_not_ready' WHEN final = 'ready_for_review' AND review = '' THEN 'eligible_for_controlled_apply' ELSE 'review_before_apply' END AS verdict FROM r""")
def rollout_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, _ROLLOUT, "id int, final string, complete boolean, warnings string, review string, config string, regression string")
    listed = lambda c: F.filter(F.array(F.col(c)), lambda x: x != "")
    return rows.select("id", review.rollout(F.col("final"), F.col("complete"), listed("warnings"), listed("review"), F.col("config"), F.col("regression"))["verdict"].alias("verdict"))


_BOUNDS = (100.0, 1000.0, 5000.0, 20000.0)


@query(" UNION ALL ".join(f"SELECT lang, '{b:g}' AS le, count(*) FILTER (WHERE n_chars <= {b}) AS n FROM documents GROUP BY lang" for b in _BOUNDS) + " UNION ALL SELECT lang, '+Inf', count(n_chars) FROM documents GROUP BY lang")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cumulative(_read(spark, sf_dir, "documents"), "n_chars", list(_BOUNDS), ["lang"])


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def label_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.histogram(_read(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT l.toxic, l.quality, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY l.toxic, l.quality")
def audit_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query()
def lexicon_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _values(spark, "('тест'), ('*весна*'), ('порусски'), ('щетка'), ('#дом')", "token string")
    terms = _values(spark, "('тёст', 0), ('текст', 1), ('вёсна', 2), ('весло', 3), ('по-русски', 4), ('щётка', 5), ('дом', 6), ('том', 7)", "term string, rank int")
    return lexicon.top_k(tokens, terms)


@query("SELECT * FROM (VALUES (1, 'белая корова и молоко', CAST(2 AS BIGINT)), (2, 'корова', CAST(1 AS BIGINT)), (3, '(карова)', CAST(0 AS BIGINT))) AS t(case_id, output, applied)")
def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _values(spark, "(1, 'белая карова и моолоко'), (2, 'корава'), (3, '(карова)')", "case_id int, text string")
    terms = _values(spark, "('корова', 0), ('молоко', 1), ('короба', 2), ('кот', 3)", "term string, rank int")
    return rerank.heuristic_replay(cases, terms).select("case_id", "output", "applied")


from . import derived_queries  # noqa: E402, F401  registers more
