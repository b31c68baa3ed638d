"""Queries of the engine's own operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnengine.functions.text import words
from turnengine.operators import align, bertscore, build, merge, metrics, patch, quality, translate
from turnengine.plans import adapters as data
from turnengine.plans import exchange
from turnengine.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
PROMPT = "Translate into the dialect."

# ---------------------------------------------------------------------------------------------------------------
# the adapters' rules as SQL

TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS conversazione, CAST(turn + 1 AS INTEGER) AS turn_index, CAST(turn AS VARCHAR) AS tu_id, role AS speaker, text AS italiano,
  conv_id, turn, conv_id * 1000000 + turn AS ord FROM conversations)"""
TOKENS = (
    TURNS
    + """, split_words AS (SELECT *, conv_id * 7 + turn AS k, string_split_regex(italiano, '\\s+') AS ws FROM turns),
tokens AS (SELECT conversazione, turn * 100000 + p AS pos, speaker, tu_id AS tu, ws[p + 1] AS form, turn,
    CASE WHEN k % 7 = 0 AND p = 1 THEN 'error' WHEN k % 11 = 0 THEN 'shortpause' ELSE 'linguistic' END AS type,
    CASE WHEN k % 5 = 0 AND p = 0 THEN 'some' ELSE 'none' END AS variation,
    CASE WHEN p % 6 = 0 THEN 'SpaceAfter=No' ELSE '_' END AS feats
  FROM (SELECT *, unnest(range(len(ws))) AS p FROM split_words)),
spoken AS (SELECT *, row_number() OVER (PARTITION BY conversazione, tu ORDER BY pos DESC) AS back FROM tokens WHERE type = 'linguistic'),
texts AS (SELECT conversazione, tu, count(*) AS n, trim(string_agg(form || CASE WHEN feats LIKE '%SpaceAfter=No%' OR back = 1 THEN '' ELSE ' ' END, '' ORDER BY pos)) AS text FROM spoken GROUP BY ALL),
units AS (SELECT t.conversazione, t.tu AS tu_id, min(t.pos) AS first_pos, arg_min(t.speaker, t.pos) AS speaker, bool_or(t.variation = 'some') AS dialect, bool_or(t.type IN ('error', 'unknown', 'anonymized')) AS bad
  FROM tokens t GROUP BY ALL),
full_units AS (SELECT u.*, coalesce(x.text, '') AS text, coalesce(x.n, 0) AS n FROM units u LEFT JOIN texts x ON u.conversazione = x.conversazione AND u.tu_id = x.tu),
kept AS (SELECT * FROM full_units WHERE NOT dialect AND NOT bad AND n > 0)"""
)
META = """meta AS (SELECT CAST(c.conv_id AS VARCHAR) AS code, n_name AS regione, r_name AS macro_regione, CASE WHEN c.conv_id % 2 = 0 THEN 'italian' ELSE 'italian,neapolitan' END AS languages
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 <> 9) c JOIN nation ON c.conv_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
BUILT = (
    TOKENS
    + ", "
    + META
    + """, built AS (SELECT k.conversazione, coalesce(m.regione, '') AS regione, coalesce(m.macro_regione, '') AS macro_regione, coalesce(m.languages, '') AS languages,
    CAST(row_number() OVER (PARTITION BY k.conversazione ORDER BY coalesce(TRY_CAST(k.tu_id AS BIGINT), 0), k.first_pos) AS INTEGER) AS turn_index, k.tu_id, k.speaker, k.text AS italiano, '' AS napoletano, '' AS note
  FROM kept k LEFT JOIN meta m ON k.conversazione = m.code)"""
)
STRUCTURE = TURNS + ", " + META + """, structure AS (SELECT t.*, coalesce(m.regione, '') AS regione, coalesce(m.macro_regione, '') AS macro_regione, coalesce(m.languages, '') AS languages, t.turn AS turn_ord, '' AS napoletano, '' AS note
  FROM turns t LEFT JOIN meta m ON t.conversazione = m.code)"""
SIDES = (
    STRUCTURE
    + """, draft AS (SELECT *, (conv_id + turn) % 6 AS m, CASE WHEN (conv_id + turn) % 6 = 1 THEN '' ELSE italiano END AS nap FROM turns WHERE (conv_id + turn) % 6 <> 5),
golden_new AS (SELECT conversazione, turn_index, ord, (conv_id + turn) % 6 AS m, CASE WHEN conv_id % 9 = 0 AND turn = 0 THEN italiano || '!' ELSE italiano END AS golden_italiano,
    CASE (conv_id + turn) % 6 WHEN 2 THEN lower(replace(italiano, 'the', 'da')) WHEN 3 THEN array_to_string(string_split_regex(italiano, '\\s+')[1:CAST(ceil(len(string_split_regex(italiano, '\\s+')) / 2.0) AS BIGINT)], ' ') ELSE italiano END AS nap,
    CASE (conv_id + turn) % 6 WHEN 3 THEN 'half' ELSE '' END AS note FROM turns WHERE (conv_id + turn) % 6 <> 4),
golden_all AS (SELECT * FROM golden_new UNION ALL SELECT conversazione, turn_index, ord - 1000000000000, m, golden_italiano, 'older', note FROM golden_new WHERE m = 2),
golden AS (SELECT * FROM golden_all QUALIFY row_number() OVER (PARTITION BY conversazione, turn_index ORDER BY ord DESC) = 1),
pairs AS (SELECT d.conversazione, d.turn_index, d.tu_id, d.speaker, d.italiano, trim(d.nap) AS gemma, trim(g.nap) AS golden, g.note, g.golden_italiano, d.ord
  FROM draft d JOIN golden g USING (conversazione, turn_index))"""
)


def _counts(name: str, source: str, order: int, units: str) -> str:
    """CTEs <name>: per pair and order, n-gram counts h, r and matches m. units: list of units of a text x."""
    return f""", {name}_u AS (SELECT conversazione, turn_index, {units.format(x='gemma')} AS h, {units.format(x='golden')} AS r FROM {source}),
{name}_o AS (SELECT *, unnest(range(1, {order + 1})) AS n FROM {name}_u),
{name}_h AS (SELECT conversazione, turn_index, n, list_slice(h, i, i + n - 1) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM {name}_o) GROUP BY ALL),
{name}_r AS (SELECT conversazione, turn_index, n, list_slice(r, i, i + n - 1) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM {name}_o) GROUP BY ALL),
{name}_m AS (SELECT conversazione, turn_index, n, sum(least(a.c, b.c)) AS m FROM {name}_h a JOIN {name}_r b USING (conversazione, turn_index, n, g) GROUP BY ALL),
{name} AS (SELECT o.conversazione, o.turn_index, o.n, greatest(len(o.h) - o.n + 1, 0) AS h, greatest(len(o.r) - o.n + 1, 0) AS r, coalesce(x.m, 0) AS m, len(o.h) AS hl, len(o.r) AS rl
  FROM {name}_o o LEFT JOIN {name}_m x USING (conversazione, turn_index, n))"""


CHARS = "list_filter(string_split(regexp_replace({x}, '\\s', '', 'g'), ''), lambda u: u <> '')"
_MARK = "[!-/:-@\\[-`{{-~]"
CHRF_WORDS = (
    "flatten(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda u: u <> ''), lambda w: CASE WHEN length(w) = 1 THEN [w] "
    f"WHEN regexp_matches(w, '{_MARK}$') THEN [left(w, length(w) - 1), right(w, 1)] WHEN regexp_matches(w, '^{_MARK}') THEN [left(w, 1), substr(w, 2)] ELSE [w] END))"
)
BLEU_WORDS = (
    "list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(replace(replace(replace(replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ', "
    "'([{{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g'), '([^0-9])([.,])', '\\1 \\2 ', 'g'), '([.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g'), '\\s+'), lambda u: u <> '')"
)
ROUGE_WORDS = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*')"
EMPTY = "gemma = '' OR golden = ''"


def _f_chrf(sources: list[str], key: str) -> str:
    """SELECT of chrF by key from count CTEs."""
    union = " UNION ALL ".join(f"SELECT {key}, h, r, m FROM {s}" for s in sources)
    return f"""SELECT {key}, coalesce(CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) END, 0) * 100 AS chrf FROM (
  SELECT {key}, sum(CASE WHEN h > 0 AND r > 0 THEN m / h ELSE 0 END) / nullif(count(*) FILTER (h > 0 AND r > 0), 0) AS p, sum(CASE WHEN h > 0 AND r > 0 THEN m / r ELSE 0 END) / nullif(count(*) FILTER (h > 0 AND r > 0), 0) AS q
  FROM ({union}) GROUP BY {key})"""


def _f_bleu(source: str, key: str, effective: bool) -> str:
    closed = "0.0" if effective else "-1e10"
    orders = "nullif(count(*) FILTER (h > 0), 0)" if effective else "4"
    return f"""SELECT {key}, CASE WHEN sum(m) > 0 AND any_value(hl) > 0 THEN (CASE WHEN any_value(hl) >= any_value(rl) THEN 1.0 ELSE exp(1 - any_value(rl) / any_value(hl)) END)
    * exp(sum(CASE WHEN h = 0 THEN {closed} WHEN m > 0 THEN ln(100.0 * m / h) ELSE ln(100.0 / (pow(2, zeros) * h)) END) / {orders}) ELSE 0 END AS bleu
  FROM (SELECT *, count(*) FILTER (m = 0 AND h > 0) OVER (PARTITION BY {key} ORDER BY n) AS zeros FROM {source}) GROUP BY {key}"""


KEY = "conversazione, turn_index"
CHRF_CTE = _counts("cc", "pairs", 6, CHARS)
WORD2_CTE = _counts("cw", "pairs", 2, CHRF_WORDS)
BLEU_CTE = _counts("cb", "pairs", 4, BLEU_WORDS)
LCS = """, rouge_words AS (SELECT conversazione, turn_index, {h} AS h, {r} AS r FROM pairs),
lcs AS (SELECT *, CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0 ELSE list_last(list_reduce(r, lambda row, w: list_reduce(range(1, len(h) + 1), lambda acc, i: list_append(acc, CASE WHEN h[i] = w THEN row[i] + 1 ELSE greatest(row[i + 1], list_last(acc)) END), [0::BIGINT]), list_transform(range(0, len(h) + 1), lambda z: 0::BIGINT))) END AS l FROM rouge_words)""".format(
    h=ROUGE_WORDS.format(x="gemma"), r=ROUGE_WORDS.format(x="golden")
)
F_ROUGE = "SELECT conversazione, turn_index, CASE WHEN l > 0 THEN 200.0 * (l / len(h)) * (l / len(r)) / (l / len(h) + l / len(r)) ELSE 0 END AS rouge FROM lcs"
SCORED = (
    SIDES + CHRF_CTE + BLEU_CTE + LCS + f", s_chrf AS ({_f_chrf(['cc'], KEY)}), s_bleu AS ({_f_bleu('cb', KEY, True)}), s_rouge AS ({F_ROUGE})"
    + f""", scores AS (SELECT p.*, CASE WHEN {EMPTY} THEN 0 ELSE c.chrf END AS chrf, CASE WHEN {EMPTY} THEN 0 ELSE b.bleu END AS bleu, CASE WHEN {EMPTY} THEN 0 ELSE r.rouge END AS rouge
  FROM pairs p JOIN s_chrf c USING ({KEY}) JOIN s_bleu b USING ({KEY}) JOIN s_rouge r USING ({KEY})),
decided AS (SELECT *, greatest(0, least(100, 0.4 / 0.7 * chrf + 0.15 / 0.7 * bleu + 0.15 / 0.7 * rouge)) AS similarita FROM scores)"""
)
#: Decisions as they are stored.
STORED = SCORED + """, stored AS (SELECT *, similarita < 85.0 AS sostituire FROM decided)"""


def _final(choice: str) -> str:
    return STORED + f""", final AS (SELECT s.conversazione, s.turn_index, s.regione, s.macro_regione, s.languages, s.tu_id, s.speaker, s.italiano, CASE WHEN {choice} THEN d.golden ELSE d.gemma END AS napoletano, '' AS note,
    CASE WHEN {choice} THEN 'golden' ELSE 'gemma4' END AS fonte, round(d.similarita, 2) AS similarita, d.gemma, d.golden FROM structure s JOIN stored d USING ({KEY}))"""


FINAL_COLUMNS = "conversazione, turn_index, regione, macro_regione, languages, tu_id, speaker, italiano, napoletano, note, fonte, similarita"
CORRECTIONS = TURNS + """, due AS (SELECT *, CASE WHEN turn = 2 THEN [{'o': 'qqq', 'n': 'e'}] WHEN turn = 0 THEN [{'o': 'the', 'n': '''o'}, {'o': 'an', 'n': 'nu'}] ELSE [{'o': 'the', 'n': '''o'}, {'o': 'zzzz', 'n': 'yyyy'}] END AS pairs FROM turns WHERE conv_id % 4 = 0 AND turn < 3),
one AS (SELECT *, CASE WHEN contains(italiano, pairs[1].o) THEN replace(italiano, pairs[1].o, pairs[1].n) ELSE italiano END AS t1, NOT contains(italiano, pairs[1].o) AND NOT contains(italiano, pairs[1].n) AS b1 FROM due),
two AS (SELECT *, CASE WHEN len(pairs) > 1 AND contains(t1, pairs[2].o) THEN replace(t1, pairs[2].o, pairs[2].n) ELSE t1 END AS t2, len(pairs) > 1 AND NOT contains(t1, pairs[2].o) AND NOT contains(t1, pairs[2].n) AS b2 FROM one),
status AS (SELECT conversazione, turn_index, CASE WHEN b1 OR b2 THEN 'not-found' WHEN t2 <> italiano THEN 'modified' ELSE 'already-correct' END AS status, CASE WHEN b1 OR b2 THEN italiano ELSE t2 END AS text FROM two
  UNION ALL SELECT DISTINCT conversazione, 9999, 'absent', '' FROM turns WHERE conv_id % 4 = 0)"""
ROWS = STRUCTURE + """, wb AS (SELECT CASE WHEN k % 19 = 0 THEN '' ELSE conversazione END AS conversazione, regione, macro_regione, languages,
    CASE WHEN k % 23 = 0 THEN 'a' WHEN k % 29 = 0 AND turn > 0 THEN CAST(turn AS VARCHAR) ELSE CAST(turn_index AS VARCHAR) END AS turn_index, tu_id, speaker, italiano,
    CASE WHEN k % 31 = 0 THEN '' ELSE italiano END AS napoletano, CASE WHEN k % 3 = 0 THEN 'checked' ELSE '' END AS note, ord AS pos FROM (SELECT *, conv_id * 7 + turn AS k FROM structure)),
numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY pos) + 1 AS INTEGER) AS data_row, TRY_CAST(turn_index AS INTEGER) AS turn_no FROM wb),
marked AS (SELECT *, CASE WHEN conversazione = '' THEN 'empty_conversation' WHEN turn_no IS NULL THEN 'bad_turn_index' WHEN row_number() OVER (PARTITION BY conversazione, turn_no ORDER BY pos) > 1 THEN 'duplicate_turn_index' END AS problem FROM numbered)"""
EDITED = STRUCTURE + """, edited AS (SELECT conversazione, turn_index, tu_id, CASE WHEN k % 17 = 0 THEN 'other' ELSE speaker END AS speaker, CASE WHEN k % 13 = 0 THEN substr(italiano, 2) ELSE italiano END AS italiano, regione, macro_regione, languages, napoletano, turn_ord
  FROM (SELECT *, conv_id * 7 + turn AS k FROM structure) WHERE NOT (conv_id % 8 = 0 AND turn = 1))"""
CONTEXT = TURNS + """, shown AS (SELECT *, CASE WHEN (conv_id + turn) % 6 = 1 THEN '' ELSE italiano END AS nap FROM turns),
lines AS (SELECT *, coalesce(string_agg('- ' || italiano || CASE WHEN nap <> '' THEN '  ->  ' || nap ELSE '' END, chr(10) ) OVER (PARTITION BY conversazione ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context_text,
    count(*) OVER (PARTITION BY conversazione ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS n_context FROM shown)"""

REVIEW = STRUCTURE + """, review AS (SELECT conversazione, regione, macro_regione, languages, turn_index, tu_id, speaker, italiano, CASE WHEN k % 11 = 0 THEN chr(39) ELSE '' END || italiano AS napoletano, CASE WHEN k % 3 = 0 THEN 'checked' ELSE '' END AS note
  FROM (SELECT *, conv_id * 7 + turn AS k FROM structure)),
as_text AS (SELECT * REPLACE (CAST(turn_index AS VARCHAR) AS turn_index) FROM review)"""


def _toy(chosen: str) -> str:
    """CTEs that translate turn by turn as exchange.toy does; chosen: which open turns of toy_turns are translated."""
    return f"""WITH RECURSIVE {TURNS}, toy_turns AS (SELECT *, CASE WHEN (conv_id + turn) % 6 = 1 THEN '' ELSE italiano END AS given, CAST(row_number() OVER (PARTITION BY conversazione ORDER BY turn) AS INTEGER) AS i FROM turns),
  ranked AS (SELECT *, given = '' AND length(italiano) % 5 <> 0 AS may, sum(CASE WHEN given = '' AND length(italiano) % 5 <> 0 THEN 1 ELSE 0 END) OVER (ORDER BY conversazione, turn) AS nth FROM toy_turns),
  marked AS (SELECT *, {chosen} AS chosen FROM ranked),
  steps AS (SELECT conversazione, 0 AS i, CAST(NULL AS INTEGER) AS turn_index, CAST(NULL AS VARCHAR) AS napoletano, false AS fresh, CAST([] AS VARCHAR[]) AS before FROM (SELECT DISTINCT conversazione FROM turns)
    UNION ALL SELECT s.conversazione, m.i, m.turn_index, n.nap, m.chosen, list_append(s.before, '- ' || m.italiano || CASE WHEN n.nap <> '' THEN '  ->  ' || n.nap ELSE '' END)[-4:]
    FROM steps s JOIN marked m ON m.conversazione = s.conversazione AND m.i = s.i + 1,
    LATERAL (SELECT CASE WHEN len(s.before) > 0 THEN 'Context:' || chr(10) || array_to_string(s.before, chr(10)) || chr(10) || chr(10) ELSE '' END || 'Translate:' || chr(10) || m.italiano AS asked) q,
    LATERAL (SELECT CASE WHEN m.given <> '' THEN m.given WHEN m.chosen THEN length(q.asked) || ':' || right(q.asked, 20) ELSE '' END AS nap) n)"""


#: Paragraphs of a score report: parameters, means, warnings, pairs.
REPORT = SCORED + CHRF_CTE.replace("cc", "rc") + BLEU_CTE.replace("cb", "rb") + f""", tc AS (SELECT 1 AS one, n, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM rc GROUP BY n), tb AS (SELECT 1 AS one, n, sum(h) AS h, sum(r) AS r, sum(m) AS m, sum(hl) AS hl, sum(rl) AS rl FROM rb GROUP BY n),
  totals AS (SELECT count(*) AS n, avg(chrf) AS c, avg(bleu) AS b, avg(rouge) AS r, avg(similarita) AS s, count(*) FILTER (similarita < 85.0) AS bad, count(*) FILTER (similarita >= 99.995) AS same FROM decided),
  corpus AS (SELECT chrf, bleu FROM ({_f_chrf(['tc'], 'one')}) JOIN ({_f_bleu('tb', 'one', False)}) USING (one)),
  lonely AS (SELECT conversazione, turn_index, row_number() OVER (ORDER BY conversazione, turn_index) AS nth FROM (SELECT conversazione, turn_index FROM draft EXCEPT SELECT conversazione, turn_index FROM golden)),
  lf AS (SELECT chr(10) AS nl)
SELECT 'hypothesis: draft.json' || nl || 'reference: golden.json' || nl || 'pairs: ' || n || nl || 'BERTScore: off' || nl || 'chrF word order: 0' || nl || 'weights: chrf 57%, bleu 21%, rouge 21%' || nl || 'threshold: replace below 85.0%' AS paragraph FROM totals, lf
UNION ALL SELECT 'mean BERTScore F1: n/d' || nl || printf('mean sentence BLEU: %.2f', b) || nl || printf('mean ROUGE-L F1: %.4f', r / 100) || nl || printf('mean sentence chrF: %.2f', c) || nl || printf('corpus BLEU: %.2f', bleu) || nl || printf('corpus chrF: %.2f', chrf) || nl || printf('mean similarity: %.2f %%', s) || nl
  || printf('to replace: %d/%d (%.1f%%)', bad, n, 100.0 * bad / n) || nl || 'identical: ' || same FROM totals, corpus, lf
UNION ALL SELECT 'warnings: ' || count(*) || nl || string_agg('  - draft only ' || conversazione || ' ' || turn_index, chr(10) ORDER BY nth) FILTER (nth <= 30) || CASE WHEN count(*) > 30 THEN nl || '  ... and ' || (count(*) - 30) || ' more' ELSE '' END FROM lonely, lf GROUP BY nl
UNION ALL SELECT '[' || conversazione || ' | turn ' || turn_index || ' | tu_id ' || tu_id || ' | speaker ' || speaker || ']' || nl || '  it: ' || italiano || nl || '  draft: ' || gemma || nl || '  golden: ' || golden || nl
  || printf('  chrF %.2f  BLEU %.2f  ROUGE-L %.4f  BERTScore n/d  similarity %.2f %%  ', round(chrf, 2), round(bleu, 2), round(rouge / 100, 4), round(similarita, 2)) || CASE WHEN similarita < 85.0 THEN 'REPLACE' ELSE 'keep' END || CASE WHEN note <> '' THEN nl || '  note: ' || note ELSE '' END FROM decided, lf"""

# ---------------------------------------------------------------------------------------------------------------
# queries


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return align.align_pairs(data.draft(spark, d), data.golden(spark, d))


def _built(spark: SparkSession, d: str) -> DataFrame:
    return build.build_turns(data.tokens(spark, d), data.metadata(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return metrics.decisions(_pairs(spark, d))


def _merged(spark: SparkSession, d: str, **how: object) -> DataFrame:
    return merge.merge(data.structure(spark, d), _scored(spark, d), **how)


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Turns with some translations, in order."""
    nap = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) == 1, "").otherwise(F.col("italiano"))
    return data.turns(spark, d).withColumn("napoletano", nap).withColumn("turn_ord", F.col("turn"))


def _token_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as tokens: 20 consecutive ids are a pair, the first 10 its hypothesis."""
    e = data.table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 20).alias("pair_id"), F.when(F.col("vec_id") % 20 < 10, "hyp").otherwise("ref").alias("side"), (F.col("vec_id") % 10).alias("pos"), "embedding")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("7", 1), ("3", 2), ("no-such", 3)], "code string, conv_ord int")


def _known(spark: SparkSession, d: str) -> DataFrame:
    return data.turns(spark, d).select(F.col("conversazione").alias("code"))


def _select_columns(q: Query, *columns: str) -> Query:
    return lambda s, d: q(s, d).select(*columns)


def _score_only(name: str, word_order: int = 0) -> Query:
    return lambda s, d: metrics.sentence_scores(_pairs(s, d), word_order).select("conversazione", "turn_index", F.round(name, 6).alias(name))


def similarity_decision(spark: SparkSession, d: str) -> DataFrame:
    rounded = [F.round(c, 4).alias(c) for c in ("chrf", "bleu", "rouge", "similarita")]
    return _scored(spark, d).select("conversazione", "turn_index", "tu_id", "speaker", *rounded, "sostituire", "note")


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.score_summary(_scored(spark, d))
    return s.select("pairs", "to_replace", "identical", *[F.round(c, 4).alias(c) for c in ("mean_chrf", "mean_bleu", "mean_rouge", "mean_similarita")])


def corpus_chrf_bleu(spark: SparkSession, d: str) -> DataFrame:
    return metrics.corpus_scores(_pairs(spark, d)).select(F.round("corpus_chrf", 6).alias("corpus_chrf"), F.round("corpus_bleu", 6).alias("corpus_bleu"))


def conversation_nest_summary(spark: SparkSession, d: str) -> DataFrame:
    return build.nest(_built(spark, d)).select("id", "regione", "macro_regione", "languages", "n_turni_italiani", F.array_join(F.transform("turni", lambda t: F.concat(t["turn_index"].cast("string"), F.lit(":"), t["italiano"])), "|").alias("texts"))


def flatten_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return build.flatten(build.nest(_built(spark, d))).drop("turn_ord")


def greedy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.greedy_match(_token_vectors(spark, d)).select("pair_id", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def corrected_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = data.turns(spark, d).withColumn("napoletano", F.col("italiano"))
    return patch.corrected(turns, data.corrections(spark, d)).select("conversazione", "turn_index", "napoletano")


def correction_status(spark: SparkSession, d: str) -> DataFrame:
    return patch.correction_status(data.turns(spark, d).withColumn("napoletano", F.col("italiano")), data.corrections(spark, d))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    rows = translate.context_window(_shown(spark, d))
    return rows.select("conversazione", "turn_index", F.size("context").cast("bigint").alias("n_context"), translate.context_lines(F.col("context")).alias("context_text"))


def build_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = translate.build_messages(translate.context_window(_shown(spark, d)), PROMPT)
    return rows.select("conversazione", "turn_index", F.col("messages")[0]["content"].alias("system_text"), F.col("messages")[1]["content"].alias("user_text"))


def translate_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Every backend call fails twice and is asked again."""
    backend = translate.with_retries(exchange.Flaky(), sleep=lambda seconds: None)
    return translate.translate(_shown(spark, d), backend, PROMPT).select("conversazione", "turn_index", "napoletano", "fresh")


def _bert_stand_in(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the composite with all four terms; the ratio of the lengths stands in for the model's score."""
    a, b = F.length("gemma"), F.length("golden")
    return metrics.decisions(_pairs(spark, d), bertscore=F.when((a == 0) | (b == 0), 0.0).otherwise(100.0 * F.least(a, b) / F.greatest(a, b)))


def similarity_with_bertscore(spark: SparkSession, d: str) -> DataFrame:
    return _bert_stand_in(spark, d).select("conversazione", "turn_index", F.round("bertscore", 4).alias("bertscore"), F.round("similarita", 4).alias("similarita"), "sostituire", bertscore.bert_text(F.col("bertscore"), True).alias("shown"))


def score_report(spark: SparkSession, d: str) -> DataFrame:
    return exchange.report_file(spark, data.draft(spark, d), data.golden(spark, d))


def score_file(spark: SparkSession, d: str) -> DataFrame:
    return exchange.score_file(spark, _scored(spark, d))


def final_files(spark: SparkSession, d: str) -> DataFrame:
    return exchange.final_files(spark, d, _scored(spark, d))


def translated_file(spark: SparkSession, d: str) -> DataFrame:
    rows = _shown(spark, d).select("conversazione", F.lit("").alias("regione"), F.lit("").alias("macro_regione"), F.lit("").alias("languages"), "turn_index", "tu_id", "speaker", "italiano", "napoletano", F.lit("").alias("note"), "turn_ord")
    return exchange.translated_file(spark, rows, PROMPT, 40, 10)


def translated_stream(spark: SparkSession, d: str) -> DataFrame:
    return exchange.translated_stream(spark, _shown(spark, d), PROMPT)


def quality_structural(spark: SparkSession, d: str) -> DataFrame:
    return quality.structural(data.workbook_rows(spark, d))


def imported_turns(spark: SparkSession, d: str) -> DataFrame:
    return quality.rows_to_turns(data.workbook_rows(spark, d))


def corpus_drift(spark: SparkSession, d: str) -> DataFrame:
    return quality.drift(data.edited(spark, d), data.renamed(data.structure(spark, d), 4, 5, "z"))


def verify_fields(spark: SparkSession, d: str) -> DataFrame:
    return quality.verify(data.edited(spark, d), data.structure(spark, d)).select("check", "conversazione", "i", "left", "right")


def verify_ids(spark: SparkSession, d: str) -> DataFrame:
    return quality.verify(data.renamed(data.edited(spark, d), 0, 3, "x"), data.renamed(data.structure(spark, d), 1, 3, "y")).select("check", "conversazione", "i", "left", "right")


UNIT = ("conversazione", "tu_id", "first_pos", "speaker", "text")
PAIR = ("conversazione", "turn_index", "tu_id", "speaker", "italiano", "gemma", "golden", "note")
_FINAL = tuple(FINAL_COLUMNS.split(", "))

_QUERIES: dict[str, tuple[Query, str | None]] = {
    "turn_reconstruct": (lambda s, d: build.units(data.tokens(s, d)).select(*UNIT, F.col("n").cast("bigint").alias("n")), f"WITH {TOKENS} SELECT conversazione, tu_id, first_pos, speaker, text, n FROM full_units"),
    "turn_filter_dialect_bad": (lambda s, d: build.kept_units(data.tokens(s, d)).select(*UNIT), f"WITH {TOKENS} SELECT conversazione, tu_id, first_pos, speaker, text FROM kept"),
    "turn_exclusions": (
        lambda s, d: build.units(data.tokens(s, d)).agg(F.count("*").alias("units"), F.count_if("dialect").alias("dialect"), F.count_if("bad").alias("bad"), F.count_if(F.col("n") == 0).alias("without_words")),
        f"WITH {TOKENS} SELECT count(*) AS units, count(*) FILTER (dialect) AS dialect, count(*) FILTER (bad) AS bad, count(*) FILTER (n = 0) AS without_words FROM full_units",
    ),
    "build_turns": (_built, f"WITH {BUILT} SELECT * FROM built"),
    "conversation_nest_summary": (conversation_nest_summary, f"WITH {BUILT} SELECT conversazione AS id, regione, macro_regione, languages, CAST(count(*) AS INTEGER) AS n_turni_italiani, string_agg(turn_index || ':' || italiano, '|' ORDER BY turn_index) AS texts FROM built GROUP BY ALL"),
    "dataset_summary": (lambda s, d: build.dataset_summary(_built(s, d)), f"WITH {BUILT} SELECT count(*) AS conversations, CAST(sum(n) AS BIGINT) AS turns, sum(n) / count(*) AS turns_per_conversation, count(*) FILTER (l = 'italian') AS italian_only FROM (SELECT conversazione, count(*) AS n, max(languages) AS l FROM built GROUP BY ALL)"),
    "select_conversations": (
        lambda s, d: data.turns(s, d).join(F.broadcast(build.select_conversations(_known(s, d), conversations=["7", "3", "no-such"])[0]), F.col("conversazione") == F.col("code")).select("conv_ord", "conversazione", "turn_index", "italiano"),
        f"WITH {TURNS} SELECT CAST(CASE conversazione WHEN '7' THEN 1 ELSE 2 END AS INTEGER) AS conv_ord, conversazione, turn_index, italiano FROM turns WHERE conversazione IN ('7', '3')",
    ),
    "select_all": (lambda s, d: build.select_conversations(_known(s, d), everything=True)[0], f"WITH {TURNS} SELECT conversazione AS code, CAST(row_number() OVER (ORDER BY conversazione) AS INTEGER) AS conv_ord FROM (SELECT DISTINCT conversazione FROM turns)"),
    "unknown_codes": (lambda s, d: build.select_conversations(_known(s, d), conversations=["7", "3", "no-such"])[1], "SELECT 'no-such' AS code"),
    "skipped_conversations": (lambda s, d: data.turns(s, d).select("conversazione").distinct().join(_built(s, d), "conversazione", "left_anti"), f"WITH {BUILT} SELECT DISTINCT conversazione FROM turns WHERE conversazione NOT IN (SELECT conversazione FROM built)"),
    "align_pairs": (_select_columns(_pairs, *PAIR), f"WITH {SIDES} SELECT {', '.join(PAIR)} FROM pairs"),
    "align_only": (lambda s, d: align.align_pairs(data.draft(s, d), data.golden(s, d), only=_asked(s)).select(*PAIR), f"WITH {SIDES} SELECT {', '.join(PAIR)} FROM pairs WHERE conversazione IN ('7', '3')"),
    "align_limit": (lambda s, d: align.first_pairs(_pairs(s, d), 25).select(*PAIR), f"WITH {SIDES} SELECT {', '.join(PAIR)} FROM pairs ORDER BY ord LIMIT 25"),
    "misaligned_draft_only": (lambda s, d: align.misaligned(data.draft(s, d), data.golden(s, d))[0], f"WITH {SIDES} SELECT conversazione, turn_index FROM draft EXCEPT SELECT conversazione, turn_index FROM golden"),
    "misaligned_golden_only": (lambda s, d: align.misaligned(data.draft(s, d), data.golden(s, d))[1], f"WITH {SIDES} SELECT conversazione, turn_index FROM golden EXCEPT SELECT conversazione, turn_index FROM draft"),
    "source_text_mismatch": (lambda s, d: align.source_mismatch(_pairs(s, d)).select("conversazione", "turn_index", "italiano", "golden_italiano"), f"WITH {SIDES} SELECT conversazione, turn_index, italiano, golden_italiano FROM pairs WHERE italiano <> golden_italiano"),
    "tokenize_unicode": (lambda s, d: data.turns(s, d).select("conversazione", "turn_index", F.size(words(F.col("italiano"))).cast("bigint").alias("n"), F.array_join(words(F.col("italiano")), " ").alias("tokens")), f"WITH {TURNS}, t AS (SELECT conversazione, turn_index, {ROUGE_WORDS.format(x='italiano')} AS w FROM turns) SELECT conversazione, turn_index, len(w) AS n, array_to_string(w, ' ') AS tokens FROM t"),
    "chrf_sentence": (_score_only("chrf"), f"WITH {SIDES} {CHRF_CTE} SELECT s.conversazione, s.turn_index, round(CASE WHEN {EMPTY} THEN 0 ELSE s.chrf END, 6) AS chrf FROM ({_f_chrf(['cc'], KEY)}) s JOIN pairs USING ({KEY})"),
    "chrfpp_sentence": (_score_only("chrf", 2), f"WITH {SIDES} {CHRF_CTE} {WORD2_CTE} SELECT s.conversazione, s.turn_index, round(CASE WHEN {EMPTY} THEN 0 ELSE s.chrf END, 6) AS chrf FROM ({_f_chrf(['cc', 'cw'], KEY)}) s JOIN pairs USING ({KEY})"),
    "bleu_sentence": (_score_only("bleu"), f"WITH {SIDES} {BLEU_CTE} SELECT s.conversazione, s.turn_index, round(CASE WHEN {EMPTY} THEN 0 ELSE s.bleu END, 6) AS bleu FROM ({_f_bleu('cb', KEY, True)}) s JOIN pairs USING ({KEY})"),
    "corpus_chrf_bleu": (
        corpus_chrf_bleu,
        f"WITH {SIDES} {CHRF_CTE} {BLEU_CTE}, tc AS (SELECT 1 AS one, n, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM cc GROUP BY n), tb AS (SELECT 1 AS one, n, sum(h) AS h, sum(r) AS r, sum(m) AS m, sum(hl) AS hl, sum(rl) AS rl FROM cb GROUP BY n) "
        f"SELECT round(chrf, 6) AS corpus_chrf, round(bleu, 6) AS corpus_bleu FROM ({_f_chrf(['tc'], 'one')}) JOIN ({_f_bleu('tb', 'one', False)}) USING (one)",
    ),
    "rouge_l": (_score_only("rouge"), f"WITH {SIDES} {LCS} SELECT s.conversazione, s.turn_index, round(CASE WHEN {EMPTY} THEN 0 ELSE s.rouge END, 6) AS rouge FROM ({F_ROUGE}) s JOIN pairs USING ({KEY})"),
    "bertscore_greedy": (
        greedy,
        """WITH t AS (SELECT vec_id // 20 AS pair_id, vec_id % 20 < 10 AS hyp, vec_id % 10 AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    c AS (SELECT h.pair_id, h.pos AS i, r.pos AS j, list_cosine_similarity(h.v, r.v) AS cos FROM t h JOIN t r ON h.pair_id = r.pair_id AND h.hyp AND NOT r.hyp),
    p AS (SELECT pair_id, avg(m) AS p FROM (SELECT pair_id, i, max(cos) AS m FROM c GROUP BY ALL) GROUP BY ALL), r AS (SELECT pair_id, avg(m) AS r FROM (SELECT pair_id, j, max(cos) AS m FROM c GROUP BY ALL) GROUP BY ALL)
    SELECT pair_id, round(p * 100, 4) AS precision, round(r * 100, 4) AS recall, round(200 * p * r / (p + r), 4) AS f1 FROM p JOIN r USING (pair_id)""",
    ),
    "similarity_decision": (similarity_decision, f"WITH {SCORED} SELECT conversazione, turn_index, tu_id, speaker, round(chrf, 4) AS chrf, round(bleu, 4) AS bleu, round(rouge, 4) AS rouge, round(similarita, 4) AS similarita, similarita < 85.0 AS sostituire, note FROM decided"),
    "score_summary": (score_summary, f"WITH {SCORED} SELECT count(*) AS pairs, count(*) FILTER (similarita < 85.0) AS to_replace, count(*) FILTER (similarita >= 99.995) AS identical, round(avg(chrf), 4) AS mean_chrf, round(avg(bleu), 4) AS mean_bleu, round(avg(rouge), 4) AS mean_rouge, round(avg(similarita), 4) AS mean_similarita FROM decided"),
    "merge_by_decision": (lambda s, d: _merged(s, d).select(*_FINAL), f"WITH {_final('d.sostituire')} SELECT {FINAL_COLUMNS} FROM final"),
    "merge_rethreshold": (lambda s, d: _merged(s, d, threshold=60.0).select(*_FINAL), f"WITH {_final('d.similarita < 60.0')} SELECT {FINAL_COLUMNS} FROM final"),
    "merge_golden_only": (lambda s, d: _merged(s, d, golden_only=True).select(*_FINAL), f"WITH {_final('true')} SELECT {FINAL_COLUMNS} FROM final"),
    "merge_without_source": (lambda s, d: _merged(s, d).select(*_FINAL[:-2]), f"WITH {_final('d.sostituire')} SELECT {', '.join(_FINAL[:-2])} FROM final"),
    "merge_conversations": (lambda s, d: merge.all_conversations(data.structure(s, d), _merged(s, d)), f"WITH {_final('d.sostituire')} SELECT conversazione, count(f.turn_index) AS n_turni_italiani FROM (SELECT DISTINCT conversazione FROM structure) LEFT JOIN final f USING (conversazione) GROUP BY ALL"),
    "source_counts": (lambda s, d: merge.source_counts(_merged(s, d)), f"WITH {_final('d.sostituire')} SELECT count(*) AS total, count(*) FILTER (fonte = 'golden') AS golden, count(*) FILTER (fonte = 'golden') * 100.0 / count(*) AS golden_pct, count(*) FILTER (fonte = 'gemma4') AS gemma4, count(*) FILTER (fonte = 'gemma4') * 100.0 / count(*) AS gemma4_pct FROM final"),
    "turns_without_decision": (lambda s, d: merge.undecided(data.structure(s, d), _pairs(s, d)), f"WITH {SIDES} SELECT conversazione, turn_index, italiano FROM structure ANTI JOIN pairs USING ({KEY})"),
    "riskiest_kept_topk": (lambda s, d: merge.riskiest(_merged(s, d, threshold=60.0)), f"WITH {_final('d.similarita < 60.0')} SELECT similarita, conversazione, turn_index, gemma, golden FROM final WHERE fonte = 'gemma4' AND gemma <> golden ORDER BY similarita, conversazione, turn_index, gemma, golden LIMIT 10"),
    "apply_corrections": (corrected_turns, f"WITH {CORRECTIONS} SELECT t.conversazione, t.turn_index, coalesce(s.text, t.italiano) AS napoletano FROM turns t LEFT JOIN status s USING ({KEY})"),
    "correction_status": (correction_status, f"WITH {CORRECTIONS} SELECT conversazione, CAST(turn_index AS INTEGER) AS turn_index, status, text FROM status"),
    "quality_structural": (
        quality_structural,
        f"""WITH {ROWS} SELECT problem AS "check", conversazione, turn_index AS turn, data_row FROM marked WHERE problem IS NOT NULL
    UNION ALL SELECT 'empty_napoletano', conversazione, turn_index, data_row FROM marked WHERE problem IS NULL AND napoletano = ''
    UNION ALL SELECT 'not_contiguous', conversazione, '', 0 FROM marked WHERE problem IS NULL GROUP BY conversazione HAVING min(turn_no) <> 1 OR max(turn_no) <> count(*)""",
    ),
    "imported_turns": (imported_turns, f"WITH {ROWS} SELECT conversazione, regione, macro_regione, languages, turn_no AS turn_index, tu_id, speaker, italiano, napoletano, note FROM marked WHERE problem IS NULL"),
    "corpus_drift": (
        corpus_drift,
        f"""WITH {EDITED}, source AS (SELECT * REPLACE (CASE WHEN conv_id % 5 = 4 THEN 'z' ELSE '' END || conversazione AS conversazione) FROM structure), mine AS (SELECT * FROM edited WHERE conversazione IN (SELECT conversazione FROM source)),
    j AS (SELECT m.*, s.italiano AS s_italiano, s.speaker AS s_speaker, s.tu_id AS s_tu FROM mine m LEFT JOIN source s USING ({KEY}))
    SELECT 'turn_count' AS "check", conversazione, CAST(NULL AS INTEGER) AS turn_index FROM (SELECT conversazione, count(*) AS n FROM mine GROUP BY ALL) JOIN (SELECT conversazione, count(*) AS m FROM source GROUP BY ALL) USING (conversazione) WHERE n <> m
    UNION ALL SELECT 'missing_in_source', conversazione, turn_index FROM j WHERE s_tu IS NULL
    UNION ALL SELECT 'changed_italiano', conversazione, turn_index FROM j WHERE s_tu IS NOT NULL AND italiano IS DISTINCT FROM s_italiano
    UNION ALL SELECT 'changed_speaker', conversazione, turn_index FROM j WHERE s_tu IS NOT NULL AND speaker IS DISTINCT FROM s_speaker
    UNION ALL SELECT 'changed_tu_id', conversazione, turn_index FROM j WHERE s_tu IS NOT NULL AND tu_id IS DISTINCT FROM s_tu""",
    ),
    "verify_fields": (
        verify_fields,
        f"""WITH {EDITED}, a AS (SELECT *, CAST(row_number() OVER (PARTITION BY conversazione ORDER BY turn_ord) AS INTEGER) AS i FROM edited),
    b AS (SELECT *, CAST(row_number() OVER (PARTITION BY conversazione ORDER BY turn_ord) AS INTEGER) AS i FROM structure),
    lost AS (SELECT 'only_left' AS "check", conversazione FROM a ANTI JOIN b USING (conversazione) UNION SELECT 'only_right', conversazione FROM b ANTI JOIN a USING (conversazione)),
    d AS (SELECT conversazione, i, unnest([{{'c': 'turn_index', 'l': CAST(a.turn_index AS VARCHAR), 'r': CAST(b.turn_index AS VARCHAR)}}, {{'c': 'tu_id', 'l': a.tu_id, 'r': b.tu_id}}, {{'c': 'speaker', 'l': a.speaker, 'r': b.speaker}}, {{'c': 'italiano', 'l': a.italiano, 'r': b.italiano}}, {{'c': 'napoletano', 'l': a.napoletano, 'r': b.napoletano}}]) AS x FROM a JOIN b USING (conversazione, i))
    SELECT "check", conversazione, CAST(NULL AS INTEGER) AS i, CAST(NULL AS VARCHAR) AS "left", CAST(NULL AS VARCHAR) AS "right" FROM lost
    UNION ALL SELECT 'turns', conversazione, NULL, CAST(n AS VARCHAR), CAST(m AS VARCHAR) FROM (SELECT conversazione, count(*) AS n FROM a GROUP BY ALL) JOIN (SELECT conversazione, count(*) AS m FROM b GROUP BY ALL) USING (conversazione) WHERE n <> m AND NOT EXISTS (FROM lost)
    UNION ALL SELECT x.c, conversazione, i, x.l, x.r FROM d WHERE x.l IS DISTINCT FROM x.r AND NOT EXISTS (FROM lost)""",
    ),
    "verify_ids": (
        verify_ids,
        f"""WITH {STRUCTURE}, a AS (SELECT DISTINCT CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE '' END || conversazione AS conversazione FROM structure WHERE NOT (conv_id % 8 = 0 AND turn = 1)), b AS (SELECT DISTINCT CASE WHEN conv_id % 3 = 1 THEN 'y' ELSE '' END || conversazione AS conversazione FROM structure)
    SELECT CASE WHEN conversazione IN (FROM a) THEN 'only_left' ELSE 'only_right' END AS "check", conversazione, CAST(NULL AS INTEGER) AS i, CAST(NULL AS VARCHAR) AS "left", CAST(NULL AS VARCHAR) AS "right"
    FROM (FROM a UNION FROM b) WHERE (conversazione IN (FROM a)) <> (conversazione IN (FROM b))""",
    ),
    "token_files": (
        exchange.token_files,
        f"WITH {TOKENS} SELECT conversazione, CAST(CASE WHEN nth = 1 THEN 1 ELSE nth + 1 END AS BIGINT) AS pos, speaker, tu, form, type, variation, feats FROM (SELECT *, row_number() OVER (PARTITION BY conversazione ORDER BY pos) AS nth FROM tokens)",
    ),
    "metadata_file": (exchange.metadata_file, f"WITH {META} SELECT code, regione, macro_regione, languages FROM meta"),
    "sample_files": (exchange.sample_files, f"WITH {REVIEW} SELECT kind, review.* FROM review, (VALUES ('array'), ('lines'), ('object')) AS k(kind) WHERE kind <> 'object' OR conversazione = (SELECT min(conversazione) FROM review)"),
    "saved_files": (exchange.saved_files, f"WITH {REVIEW} SELECT 'csv' AS kind, * FROM as_text UNION ALL SELECT 'json', * REPLACE ('' AS note) FROM as_text"),
    "import_files": (exchange.import_files, f"WITH {REVIEW} SELECT 'csv' AS kind, * FROM as_text UNION ALL SELECT 'json', * REPLACE ('' AS note) FROM as_text"),
    "workbook_files": (
        exchange.workbook_files,
        f"WITH {REVIEW} SELECT kind, as_text.*, row_number() OVER (PARTITION BY kind ORDER BY conversazione, CAST(turn_index AS INTEGER)) - 1 AS pos FROM as_text, (VALUES ('single'), ('split')) AS k(kind)",
    ),
    "score_file": (
        score_file,
        f"WITH {SCORED} SELECT conversazione, turn_index, tu_id, speaker, italiano, gemma, golden, note, '0.0' AS bertscore, CAST(round(bleu, 4) AS VARCHAR) AS bleu, CAST(round(rouge, 4) AS VARCHAR) AS rouge, CAST(round(chrf, 4) AS VARCHAR) AS chrf, round(similarita, 4) AS similarita, similarita < 85.0 AS sostituire FROM decided",
    ),
    "score_report": (score_report, f"WITH {REPORT}"),
    "final_files": (
        final_files,
        f"""WITH {_final('d.sostituire').replace('round(d.similarita, 2)', 'round(round(d.similarita, 4), 2)')}, t AS (SELECT {FINAL_COLUMNS} FROM final)
    SELECT 'with' AS kind, * REPLACE (CAST(turn_index AS VARCHAR) AS turn_index) FROM t UNION ALL SELECT 'without', * REPLACE (CAST(turn_index AS VARCHAR) AS turn_index, '' AS fonte, NULL AS similarita) FROM t
    UNION ALL SELECT 'json', * REPLACE (CAST(turn_index AS VARCHAR) AS turn_index, NULL AS similarita) FROM t""",
    ),
    "regrouped_conversations": (
        lambda s, d: exchange.regrouped(s, d, _scored(s, d)),
        f"""WITH {_final('d.sostituire')}, left_over AS (SELECT * FROM final WHERE CAST(conversazione AS INTEGER) % 4 <> 1)
    SELECT s.conversazione AS id, any_value(s.regione) AS regione, any_value(s.macro_regione) AS macro_regione, any_value(s.languages) AS languages, CAST(count(f.turn_index) AS INTEGER) AS n_turni_italiani, CAST(count(f.turn_index) AS INTEGER) AS n,
      coalesce(string_agg(f.turn_index || ':' || f.fonte, '|' ORDER BY f.turn_index), '') AS turns FROM structure s LEFT JOIN left_over f USING ({KEY}) GROUP BY s.conversazione""",
    ),
    "gates": (
        exchange.gates,
        f"""WITH {ROWS}, problems AS (SELECT 1 FROM marked WHERE problem IS NOT NULL UNION ALL SELECT 1 FROM marked WHERE problem IS NULL AND napoletano = '' UNION ALL SELECT 1 FROM marked WHERE problem IS NULL GROUP BY conversazione HAVING min(turn_no) <> 1 OR max(turn_no) <> count(*)),
    mine AS (SELECT *, conv_id * 7 + turn AS k FROM structure WHERE NOT (conv_id % 8 = 0 AND turn = 1)),
    drifted AS (SELECT 1 FROM mine WHERE k % 13 = 0 UNION ALL SELECT 1 FROM mine WHERE k % 17 = 0 UNION ALL SELECT DISTINCT ON (conversazione) 1 FROM structure WHERE conv_id % 8 = 0 AND turn = 1)
    SELECT 'structural' AS gate, CAST(least(count(*), 25) AS INTEGER) AS shown, count(*) > 25 AS more FROM problems UNION ALL SELECT 'drift', CAST(least(count(*), 25) AS INTEGER), count(*) > 25 FROM drifted UNION ALL SELECT 'none', 0, false""",
    ),
    "fixed_file": (exchange.fixed_file, f"WITH {CORRECTIONS} SELECT t.conversazione, t.turn_index, coalesce(s.text, t.italiano) AS napoletano FROM turns t LEFT JOIN status s USING ({KEY})"),
    "built_file": (
        exchange.built_file,
        f"WITH {BUILT} SELECT CAST(dense_rank() OVER (ORDER BY CASE conversazione WHEN '7' THEN 1 WHEN '3' THEN 2 ELSE 3 END) AS INTEGER) AS place, built.* REPLACE (CAST(turn_index AS VARCHAR) AS turn_index) FROM built WHERE conversazione IN ('7', '3', '10')",
    ),
    "similarity_with_bertscore": (
        similarity_with_bertscore,
        f"""WITH {SCORED}, four AS (SELECT *, CASE WHEN {EMPTY} THEN 0.0 ELSE 100.0 * least(length(gemma), length(golden)) / greatest(length(gemma), length(golden)) END AS bert FROM scores),
    comp AS (SELECT *, greatest(0, least(100, 0.4 * chrf + 0.3 * bert + 0.15 * bleu + 0.15 * rouge)) AS s FROM four)
    SELECT conversazione, turn_index, round(bert, 4) AS bertscore, round(s, 4) AS similarita, s < 85.0 AS sostituire, printf('%.4f', round(bert / 100, 4)) AS shown FROM comp""",
    ),
    "translated_file": (translated_file, f"{_toy('may AND nth <= 40')} SELECT conversazione, turn_index, napoletano FROM steps WHERE i > 0"),
    "context_window": (context_window, f"WITH {CONTEXT} SELECT conversazione, turn_index, n_context, context_text FROM lines"),
    "build_messages": (build_messages, f"WITH {CONTEXT} SELECT conversazione, turn_index, '{PROMPT}' AS system_text, CASE WHEN n_context > 0 THEN 'Context:' || chr(10) || context_text || chr(10) || chr(10) ELSE '' END || 'Translate:' || chr(10) || italiano AS user_text FROM lines"),
    "todo_turns": (lambda s, d: build.todo_turns(_shown(s, d)).select("conversazione", "turn_index", "italiano"), f"WITH {TURNS} SELECT conversazione, turn_index, italiano FROM turns WHERE (conv_id + turn) % 6 = 1"),
    "todo_counts": (lambda s, d: _shown(s, d).groupBy("conversazione").agg(F.count("*").alias("turns"), F.count_if(F.col("napoletano") == "").alias("todo")), f"WITH {TURNS} SELECT conversazione, count(*) AS turns, count(*) FILTER ((conv_id + turn) % 6 = 1) AS todo FROM turns GROUP BY ALL"),
    "flatten_roundtrip": (flatten_roundtrip, f"WITH {BUILT} SELECT * FROM built"),
    "notes_per_conversation": (lambda s, d: build.conversation_counts(data.golden(s, d)).select("conversazione", "notes"), f"WITH {SIDES} SELECT conversazione, count(*) FILTER (note <> '') AS notes FROM golden_all GROUP BY ALL"),
    "translated_stream": (translated_stream, f"""{_toy("given = ''")} SELECT conversazione, turn_index, napoletano, fresh FROM steps WHERE i > 0"""),
    "translate_sequential": (translate_sequential, f"""{_toy("given = ''")} SELECT conversazione, turn_index, napoletano, fresh FROM steps WHERE i > 0"""),
}


def _shipped(q: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return q(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(q) for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
