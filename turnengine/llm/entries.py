"""Queries of this subpackage and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnengine.llm import elkan_codes, embed_forest, html_main, jacobi_whiten, mixing, ngram_lm, packing, pfor, pivot_topk, secret_scan, simhash, tool_chat, toxicity
from turnengine.llm.common import materialize, table
from turnengine.llm.tokens import public_path


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_chat.link_tool_calls(tool_chat.demo_messages(table(spark, sf_dir, "conversations")), tool_chat.DEMO_SCHEMAS)


def op2_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to four places, so that the order in which logs are added does not show."""
    scores = ngram_lm.score_corpus(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_tokens", *[F.round(c, 4).alias(c) for c in ("mean_log_score", "log_score")])


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_store(pfor.write_store(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), "spaced", end_id=0))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def planted_vectors(embeddings: DataFrame) -> DataFrame:
    """Every vector and a copy of it (vec_id + 1,000,000), whose components are scaled by 1 - f, 1 and 1 + f in turn, with
    f from 0.2 to 0.6 by vec_id; copies of f up to 0.4 are within the limit of their vector."""
    f = F.lit(0.2) + F.lit(0.1) * (F.col("vec_id") % 5)
    copy = F.transform("embedding", lambda x, i: (x.cast("double") * (F.lit(1.0) + f * (i % 3 - 1))).cast("float"))
    return embeddings.select("vec_id", "label", "embedding").union(embeddings.select(F.col("vec_id") + 1_000_000, "label", copy))


def near_vectors_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op5 on vectors that have near copies; the table's own vectors have none."""
    return embed_forest.near_vectors(planted_vectors(table(spark, sf_dir, "embeddings")))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6, which SQL can check."""
    return secret_scan.secret_digest(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def sign_fingerprints(embeddings: DataFrame) -> DataFrame:
    """(doc_id, fp): bit i is the sign of component i of a vector; and a copy of each (doc_id + 1,000,000) in which the bits
    7 id, 7 id + 13, ... (modulo 64) differ, as many as id mod 5."""
    signs = F.expr("aggregate(sequence(0, 63), 0L, (a, i) -> a | if(get(embedding, i) > 0, shiftleft(1L, i), 0L))")
    flips = F.expr("aggregate(sequence(0, 4), 0L, (a, j) -> a | if(j < vec_id % 5, shiftleft(1L, int((7 * vec_id + 13 * j) % 64)), 0L))")
    return embeddings.select(F.col("vec_id").alias("doc_id"), signs.alias("fp")).union(embeddings.select(F.col("vec_id") + 1_000_000, signs.bitwiseXOR(flips)))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid join and the components of op8 from fingerprints that SQL can make, too."""
    return simhash.fingerprint_components(materialize(sign_fingerprints(table(spark, sf_dir, "embeddings")), "signs"))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"))


PACKED = packing.Limits(max_tokens=1024, max_segments=6, max_loss=400)


def packed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as whole instruction examples under all three limits of op10's packer (the words of its texts as
    tokens, those of assistant turns as loss-bearing): in how many sequences each lies (0 if it is over a limit by itself
    and may not be cut), whether those keep the limits, and, the same in every row, the least number of sequences that
    the sums of the examples allow and whether the packer used no more than a quarter above it and one a partition."""
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    by = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("example_id"))
    examples = materialize(by.agg(F.sum(words).alias("n_tokens"), F.sum(F.when(F.col("role") == "assistant", words).otherwise(0)).alias("loss_tokens")), "examples")
    fitting = examples.where((F.col("n_tokens") <= PACKED.max_tokens) & (F.col("loss_tokens") <= PACKED.max_loss))
    placed = materialize(packing.pack_examples(fitting, PACKED), "packed").join(examples, "example_id")
    full = placed.groupBy("sequence_id").agg(F.sum("n_tokens").alias("t"), F.sum("loss_tokens").alias("l"), F.count("*").alias("s"))
    kept = (F.col("t") <= PACKED.max_tokens) & (F.col("l") <= PACKED.max_loss) & (F.col("s") <= PACKED.max_segments)
    per = placed.join(full, "sequence_id").groupBy("example_id").agg(F.count("*").alias("sequences"), F.bool_and(kept).alias("within_limits"))
    least = F.greatest(*[F.ceil(F.sum(c) / F.lit(limit)) for c, limit in (("t", PACKED.max_tokens), ("l", PACKED.max_loss), ("s", PACKED.max_segments))])
    parts = F.count_distinct(F.shiftright("sequence_id", 32))
    packed = full.agg(F.coalesce(least, F.lit(0)).alias("least_sequences"), (F.count("*") <= 1.25 * F.coalesce(least, F.lit(0)) + parts).alias("packed_well"))  # one row
    return examples.join(per, "example_id", "left").join(F.broadcast(packed)).select(
        "example_id", "n_tokens", "loss_tokens", F.coalesce("sequences", F.lit(0)).alias("sequences"), F.coalesce("within_limits", F.lit(False)).alias("within_limits"), "least_sequences", "packed_well",
    )


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), "bare", end_id=1)


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan_codes.product_codes(table(spark, sf_dir, "embeddings"))


def op12_jacobi_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jacobi_whiten.whiten(table(spark, sf_dir, "embeddings"))


def whitening_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op12: the fit list's size and every row's deviation, how many components a row has, and that
    whitening gives the identity."""
    rows = jacobi_whiten.whiten(table(spark, sf_dir, "embeddings"))
    return rows.groupBy("vec_id", "n", "deviation").agg(F.count("*").alias("components"), F.bool_and(F.col("identity_error") <= 1e-4).alias("is_identity"))


def op13_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH stats AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
weighted AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars, 0.5) ELSE 0.0 END AS weight FROM stats),
rates AS (SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(chars) FROM weighted) / chars ELSE 1.0 END AS rate FROM weighted),
parts AS (SELECT *, CAST(greatest(ceil(rate / 16.0), 1) AS BIGINT) AS draws FROM rates),
terms AS (SELECT source, draws, k, exp(-(rate / draws) + k * ln(greatest(rate / draws, 1e-300)) - lgamma(k + 1)) AS p FROM parts, range(0, 96) AS r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms),
lists AS (SELECT source, list(upto) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, CAST(list_sum(list_transform(range(1, p.draws + 1), lambda j: len(list_filter(l.cdf, lambda c: c <= CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS BIGINT) AS n
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN lists l ON p.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, CAST(c.copy_no AS INTEGER) AS copy_no,
       substr(md5('mix-1:order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(c.copy_no AS VARCHAR)), 1, 16) AS shuffle_key
FROM drawn, LATERAL (SELECT unnest(range(0, n)) AS copy_no) AS c
"""


OP1_SQL = """
WITH RECURSIVE base AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 3 AS tool, (7 * conv_id + turn) % 11 AS flaw FROM conversations),
asked AS (SELECT *, 'c' || turn AS call_id, ['fetch', 'score', 'search'][tool + 1] AS name, ['url', 'text', 'query'][tool + 1] AS field, CASE WHEN turn % 8 IN (3, 5, 7) THEN 'c' || (turn - 2) END AS dep FROM base WHERE role = 'assistant'),
parts AS (SELECT *, CASE flaw WHEN 0 THEN NULL WHEN 1 THEN '"' || field || '":7' ELSE '"' || field || '":' || CAST(to_json(text) AS VARCHAR) END AS main, CASE tool WHEN 2 THEN '"limit":' || turn WHEN 1 THEN '"weight":' || turn || '.5' END AS more, CASE flaw WHEN 2 THEN '"zz":true' END AS extra FROM asked),
calls AS (SELECT *, CASE WHEN flaw = 3 THEN CAST(to_json('{ ' || concat_ws(' , ', '"' || field || '": ' || CAST(to_json(text) AS VARCHAR), replace(more, ':', ': '))) AS VARCHAR)
    ELSE '{' || concat_ws(',', CASE tool WHEN 2 THEN more END, main, CASE tool WHEN 1 THEN more END, extra) || '}' END AS arguments,
    CASE flaw WHEN 0 THEN 'missing:' || field WHEN 1 THEN 'type:' || field WHEN 2 THEN 'unknown:zz' WHEN 3 THEN 'not_an_object' ELSE '' END AS errors FROM parts),
results AS (SELECT *, CASE WHEN (conv_id + turn) % 17 = 0 THEN 'x' ELSE 'c' END || (turn - 1) AS call_id FROM base WHERE role <> 'assistant' AND turn > 0 AND (conv_id + turn) % 13 <> 0),
linked AS (SELECT c.*, r.turn AS result_turn FROM calls c LEFT JOIN results r USING (conv_id, call_id)),
edges AS (SELECT l.conv_id, l.call_id, l.dep FROM linked l JOIN linked d ON l.conv_id = d.conv_id AND l.dep = d.call_id),
levels AS (SELECT conv_id, call_id, 0 AS level, turn AS reach, greatest(turn, result_turn) AS after FROM linked ANTI JOIN edges USING (conv_id, call_id)
  UNION ALL SELECT l.conv_id, l.call_id, p.level + 2, greatest(l.turn, p.after), greatest(l.turn, p.after, l.result_turn) FROM levels p JOIN edges e ON p.conv_id = e.conv_id AND p.call_id = e.dep JOIN linked l ON l.conv_id = e.conv_id AND l.call_id = e.call_id),
known AS (SELECT l.*, v.level, v.reach FROM linked l JOIN levels v USING (conv_id, call_id))
SELECT conv_id, turn, CAST(-1 AS INTEGER) AS place, 'message' AS node, CAST(NULL AS VARCHAR) AS call_id, 'plain' AS status, CAST(NULL AS BOOLEAN) AS args_valid, CAST(NULL AS VARCHAR) AS arg_errors, turn AS topo_turn, CAST(0 AS INTEGER) AS topo_level,
  '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}' AS canonical FROM base ANTI JOIN results USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, 0, 'call', call_id, CASE WHEN dep IS NOT NULL AND NOT EXISTS (FROM edges e WHERE e.conv_id = known.conv_id AND e.call_id = known.call_id) THEN 'lost_dependency' WHEN result_turn IS NULL THEN 'no_result' ELSE 'linked' END,
  errors = '', errors, reach, level, '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","role":"assistant","type":"call"}' FROM known
UNION ALL SELECT r.conv_id, r.turn, -1, 'result', r.call_id, CASE WHEN k.turn IS NULL THEN 'no_call' ELSE 'linked' END, NULL, NULL, greatest(r.turn, coalesce(k.reach, r.turn)), coalesce(k.level + 1, 0),
  '{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"id":"' || r.call_id || '","role":"tool","type":"result"}' FROM results r LEFT JOIN known k ON r.conv_id = k.conv_id AND r.call_id = k.call_id
"""

OP9_SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

_NEAR_SQL = """
WITH RECURSIVE {given} good AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM {table}
              WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM {table} UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM {table} e JOIN part p USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""
OP5_SQL = _NEAR_SQL.format(given="", table="embeddings")
PLANTED_SQL = _NEAR_SQL.format(
    given="""planted AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label,
    list_transform(embedding, lambda x, i: CAST(CAST(x AS DOUBLE) * (1 + (CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (vec_id % 5)) * ((i - 1) % 3 - 1)) AS FLOAT)) FROM embeddings),""",
    table="planted",
)

OP3_SQL = """
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS ws FROM documents),
tokens AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM rows_),
grams AS (SELECT r, i, n, array_to_string(ws[i - n + 1 : i], ' ') AS g FROM tokens, (VALUES (1), (2), (3)) AS o(n) WHERE i >= n),
every_ AS (SELECT n, g, count(*) AS c FROM grams GROUP BY ALL),
own AS (SELECT r, n, g, count(*) AS m FROM grams GROUP BY ALL),
others AS (SELECT x.r, x.i, x.n, e.c - o.m AS k FROM grams x JOIN every_ e USING (n, g) JOIN own o USING (r, n, g)),
wide AS (SELECT r, i, max(k) FILTER (n = 1) AS c1, max(k) FILTER (n = 2) AS c2, max(k) FILTER (n = 3) AS c3 FROM others GROUP BY r, i),
behind AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS x1, lag(c2) OVER (PARTITION BY r ORDER BY i) AS x2 FROM wide),
rest AS (SELECT r, doc_id, len(ws) AS size, (SELECT sum(len(ws)) FROM rows_) - len(ws) AS n FROM rows_),
logs AS (SELECT b.r, CASE WHEN c3 > 0 THEN ln(c3) - ln(x2) WHEN c2 > 0 THEN ln(c2) - ln(x1) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
    ELSE CASE WHEN c1 > 0 THEN ln(c1) - ln(n) ELSE -ln(n + 1) END + least(i - 1, 2) * ln(0.4) END AS s FROM behind b JOIN rest USING (r))
SELECT doc_id, CAST(size AS BIGINT) AS n_tokens, round(coalesce(sum(s), 0) / greatest(size, 1), 4) AS mean_log_score, round(coalesce(sum(s), 0), 4) AS log_score
FROM rest LEFT JOIN logs USING (r) GROUP BY r, doc_id, size
"""

PACKED_SQL = """
WITH turns AS (SELECT conv_id, role, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM conversations),
examples AS (SELECT conv_id AS example_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS loss_tokens FROM turns GROUP BY conv_id)
SELECT example_id, n_tokens, loss_tokens, CAST(CASE WHEN fits THEN 1 ELSE 0 END AS BIGINT) AS sequences, fits AS within_limits, least_sequences, true AS packed_well
FROM (SELECT *, n_tokens <= 1024 AND loss_tokens <= 400 AS fits FROM examples),
  (SELECT CAST(greatest(ceil(sum(n_tokens) / 1024.0), ceil(sum(loss_tokens) / 400.0), ceil(count(*) / 6.0)) AS BIGINT) AS least_sequences FROM examples WHERE n_tokens <= 1024 AND loss_tokens <= 400)
"""

SIGNS_SQL = """
WITH RECURSIVE signs AS (SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END)) AS UBIGINT) AS fp,
  CAST(list_sum(list_transform(range(0, 5), lambda j: CASE WHEN j < vec_id % 5 THEN CAST(pow(2, (7 * vec_id + 13 * j) % 64) AS HUGEINT) ELSE 0 END)) AS UBIGINT) AS flips FROM embeddings),
given AS (SELECT vec_id AS doc_id, fp FROM signs UNION ALL SELECT vec_id + 1000000, xor(fp, flips) FROM signs),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM given a JOIN given b ON a.doc_id <> b.doc_id AND bit_count(CAST(CAST(xor(a.fp, b.fp) AS HUGEINT) AS BIT)) <= 3),
reach(a, b) AS (SELECT doc_id, doc_id FROM given UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM given
"""

SECRETS_SQL = """
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM documents
"""

WHITENING_SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
fit AS (SELECT DISTINCT x FROM usable),
cells AS (SELECT unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM fit),
sums AS (SELECT list(s ORDER BY i) AS s, (SELECT count(*) FROM fit) AS n FROM (SELECT i, sum(v) AS s FROM cells GROUP BY i))
SELECT vec_id, n, CAST(list_sum(list_transform(list_zip(x, s), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2]))) AS BIGINT) AS deviation, CAST(16 AS BIGINT) AS components, true AS is_identity
FROM usable, sums
"""

#: The article of these pages, which have one template, by patterns.
PAGES_SQL = """
WITH bodies AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ') AS body FROM pages),
pieces AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda b: regexp_replace(b, '<[^>]*>', '', 'g')) AS blocks FROM bodies),
plain AS (SELECT page_id, url, list_transform(blocks, lambda b: regexp_replace(replace(replace(replace(regexp_replace(b, '&quot;?', '"', 'g'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS blocks FROM pieces),
texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(blocks, lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)), '') AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""


def _lloyd_sql(rounds: int = 6) -> str:
    """Plain Lloyd rounds in SQL, one expression after the other."""
    nearest = """nearest{r} AS (SELECT vec_id, label, part, x, min(struct_pack(d := d, entry := entry)) AS found FROM (
  SELECT c.vec_id, c.label, c.part, c.x, b.entry, CAST(list_sum(list_transform(list_zip(c.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM cut c JOIN books{r} b ON c.part = b.part) GROUP BY ALL)"""
    moved = """cells{r} AS (SELECT part, found.entry AS entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM nearest{r}),
means{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT part, entry, i, sum(v) AS s, count(*) AS n FROM cells{r} GROUP BY ALL) GROUP BY ALL),
books{n} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM books{r} b LEFT JOIN means{r} m ON b.part = m.part AND b.entry = m.entry)"""
    steps = [x.format(r=r, n=r + 1) for r in range(rounds) for x in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""
WITH usable AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS (SELECT vec_id, label, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS x FROM usable, range(8) AS r(part)),
books0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x FROM cut QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16),
{", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(lpad(to_hex(found.entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(found.d) AS BIGINT) AS error FROM nearest{rounds} GROUP BY vec_id, label)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM books{rounds}) AS codebooks_sha256 FROM coded
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tool_calls": op1_tool_calls,
        "op2_weak_toxicity": op2_weak_toxicity,
        "op3_stupid_backoff": op3_stupid_backoff,
        "op4_token_blocks": op4_token_blocks,
        "op5_projection_forest": op5_projection_forest,
        "op6_secret_scan": op6_secret_scan,
        "op7_poisson_mix": op7_poisson_mix,
        "op8_simhash_groups": op8_simhash_groups,
        "op9_pivot_topk": op9_pivot_topk,
        "op10_vector_packing": op10_vector_packing,
        "op11_elkan_codes": op11_elkan_codes,
        "op12_jacobi_whiten": op12_jacobi_whiten,
        "op13_html_main": op13_html_main,
        "whitening_facts": whitening_facts,
        "near_vectors_planted": near_vectors_planted,
        "secret_counts": secret_counts,
        "fingerprint_groups": fingerprint_groups,
        "packed_examples": packed_examples,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_tool_calls": OP1_SQL, "op3_stupid_backoff": OP3_SQL, "op5_projection_forest": OP5_SQL, "op7_poisson_mix": OP7_SQL, "op9_pivot_topk": OP9_SQL,
        "near_vectors_planted": PLANTED_SQL, "secret_counts": SECRETS_SQL, "fingerprint_groups": SIGNS_SQL, "packed_examples": PACKED_SQL,
        "op11_elkan_codes": _lloyd_sql(), "whitening_facts": WHITENING_SQL, "op13_html_main": PAGES_SQL,
    }
