"""The registered queries of this subpackage: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fettle.llm import contamination, jaccard, langid, licenses, linededup, lm, mixing, pieces, prefixtrie, quality, repair, tokencount, urls

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- quality rules ---------------------------------------------------------------------------------------------------

QUALITY_SQL = """
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) AS r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.lang, d.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)),
c AS (
  SELECT doc_id, lang, source, metric, CASE WHEN b > 0 THEN CAST(least(a, b) * 256 // b AS INTEGER) ELSE 0 END AS cell, least_spread
  FROM (SELECT doc_id, lang, source, 'symbols' AS metric, n_symbols AS a, word_chars AS b, 8 AS least_spread FROM m
        UNION ALL SELECT doc_id, lang, source, 'dup_lines', n_dup_lines, n_lines, 32 FROM m
        UNION ALL SELECT doc_id, lang, source, 'repeats', n_repeat_words, n_words, 32 FROM m)),
own AS (SELECT lang, source, metric, count(*) AS n, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3, any_value(least_spread) AS s
        FROM c GROUP BY ALL),
whole AS (SELECT metric, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM c GROUP BY ALL),
wider AS (SELECT lang, w.metric, (n * w.q1 + 200.0::DOUBLE * whole.q1) / (n + 200) AS q1, (n * w.q3 + 200.0::DOUBLE * whole.q3) / (n + 200) AS q3
          FROM (SELECT lang, metric, count(*) AS n, quantile_disc(cell, 0.25) AS q1, quantile_disc(cell, 0.75) AS q3 FROM c GROUP BY ALL) w
          JOIN whole ON w.metric = whole.metric),
drawn AS (SELECT own.lang, own.source, own.metric, s, (n * own.q1 + 200 * wider.q1) / (n + 200) AS q1, (n * own.q3 + 200 * wider.q3) / (n + 200) AS q3
          FROM own JOIN wider ON own.lang IS NOT DISTINCT FROM wider.lang AND own.metric = wider.metric),
fence AS (SELECT lang, source, metric, q3 + 3 * greatest(q3 - q1, s) AS top FROM drawn),
over AS (SELECT DISTINCT c.doc_id FROM c JOIN fence f
         ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source AND c.metric = f.metric AND c.cell > f.top)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND over.doc_id IS NULL AS kept
FROM m LEFT JOIN over USING (doc_id)
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# --- benchmark decontamination ---------------------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {LETTER_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {LETTER_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i:i + least(13, len(w)) - 1] AS g, least(13, len(w)) AS n
        FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dwin AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, i, n FROM dwin JOIN win USING (g, n)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(13) AS r(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_benchmark_decontamination", CONTAMINATION_SQL)
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = contamination.scan(docs, benchmark, keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# --- SentencePiece ---------------------------------------------------------------------------------------------------


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.digests(pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


# --- URL filters -----------------------------------------------------------------------------------------------------


@query("op8_url_filters")
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


# --- license scans ---------------------------------------------------------------------------------------------------


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    labels = lambda *places: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(p, lambda x: x["label"]) for p in places]))), ",")
    first = F.transform("places", lambda x: x["first_word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        labels("places").alias("base_labels"), labels("places", "fuzzy").alias("labels"), "score",
    )


# --- language ID -----------------------------------------------------------------------------------------------------


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)


# --- n-gram Jaccard join ---------------------------------------------------------------------------------------------


JACCARD_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
classes AS (SELECT min(doc_id) AS c, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
items AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
shared AS (SELECT a.c AS x, b.c AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM items a JOIN items b ON a.g = b.g AND a.c <> b.c GROUP BY a.c, b.c),
links AS (SELECT x, y FROM shared WHERE 100 * k >= 85 * (n - k)),
reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
roots AS (SELECT x AS c, min(y) AS root FROM reach GROUP BY x),
named AS (SELECT s, root FROM classes JOIN roots USING (c))
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN named ON list_sort(sets.s) = named.s
"""


@query("op1_ngram_jaccard_join", JACCARD_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


# --- line dedup --------------------------------------------------------------------------------------------------------


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_deleted").alias("n_deleted"), F.sha2("text", 256).alias("text_sha256"))


# --- token counts ------------------------------------------------------------------------------------------------------


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- LM scoring --------------------------------------------------------------------------------------------------------


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = lm.word_counts(docs)
    words = lm.vocabulary(docs, counts=counts)
    return lm.score(docs, words, lm.train(docs, words), inside=lm.shares(counts, words))


# --- mixing sources ------------------------------------------------------------------------------------------------------

# targets by repeated sharing of the excess, as many rounds as there are sources; every quotient is listed and ranked
MIXING_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source)),
fill AS (
  SELECT 0 AS round, source, source_size, w, false AS is_full, 1.5 * sum(source_size) OVER () / sum(w) OVER () AS level FROM src
  UNION ALL
  SELECT round + 1, source, source_size, w, 2 * source_size <= level * w,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (WHERE 2 * source_size <= level * w) OVER (), 0))
         / nullif(sum(w) FILTER (WHERE 2 * source_size > level * w) OVER (), 0)
  FROM fill WHERE round < (SELECT count(*) FROM src)),
tgt AS (SELECT source, source_size, is_full, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE level * w END AS target
        FROM fill WHERE round = (SELECT count(*) FROM src)),
dealt AS (SELECT d.*, CAST(('0x' || substr(digest, 1, 8)) AS BIGINT) % CAST(ceil(n_docs / 1024.0) AS BIGINT) AS shard
          FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
cells AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words FROM dealt WHERE size > 0 GROUP BY ALL),
b AS (SELECT greatest(1, least(256, min(words) // 64)) AS b FROM cells),
shards AS (SELECT source, shard, words, greatest(1, (2 * words + b) // (2 * b)) AS blocks FROM cells, b),
own AS (SELECT s.source, s.blocks, is_full, CASE WHEN is_full THEN 0.0::DOUBLE ELSE s.blocks * target / source_size END AS votes
        FROM (SELECT source, CAST(sum(blocks) AS BIGINT) AS blocks FROM shards GROUP BY source) s JOIN tgt ON s.source IS NOT DISTINCT FROM tgt.source),
seats AS (SELECT CAST(round(sum(votes)) AS BIGINT) AS n FROM own),
first AS (SELECT source, count(*) AS shared
          FROM (SELECT source, votes / (2 * k + 1) AS quotient, k FROM (SELECT source, votes, unnest(range(0, 2 * blocks + 2)) AS k FROM own WHERE votes > 0)
                ORDER BY quotient DESC, source NULLS FIRST, k LIMIT (SELECT n FROM seats)) GROUP BY source),
quota AS (SELECT own.source, CASE WHEN is_full THEN 2 * blocks ELSE least(2 * blocks, coalesce(shared, 0)) END AS source_quota
          FROM own LEFT JOIN first ON own.source IS NOT DISTINCT FROM first.source),
second AS (SELECT source, shard, count(*) AS quota
           FROM (SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY blocks / (2 * k + 1) DESC, shard, k) AS r
                 FROM (SELECT s.source, shard, blocks, source_quota, unnest(range(0, 2 * blocks + 2)) AS k
                       FROM shards s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source))
           WHERE r <= source_quota GROUP BY ALL),
placed AS (SELECT dealt.*, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dealt)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(coalesce(quota, 0) // blocks * size + greatest(0, least(size, coalesce(quota, 0) % blocks * words // blocks - start)), 0) AS BIGINT) AS taken
FROM placed p JOIN tgt ON p.source IS NOT DISTINCT FROM tgt.source
LEFT JOIN shards s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard
LEFT JOIN second q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
"""


@query("op11_mixing", MIXING_SQL)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit, with the polynomial that zlib uses."""
    bits = "list_reduce(list_prepend(xor(h, b), range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, b: {bits}), 4294967295)"


# --- conversation prefix trie --------------------------------------------------------------------------------------------

TRIE_SQL = f"""
WITH own AS (SELECT conv_id, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY turn NULLS FIRST) AS w,
                    list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS n
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT *, conv_id - conv_id % 100 AS head, CAST({crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS INTEGER) AS h FROM own),
conv AS (SELECT c.conv_id, list_concat(coalesce(p.w[1:c.h], []), c.w[c.h + 1:]) AS w, list_concat(coalesce(p.n[1:c.h], []), c.n[c.h + 1:]) AS n
         FROM cut c LEFT JOIN own p ON p.conv_id = c.head),
step AS (SELECT conv_id, d, len(w) AS size, array_to_string(w[1:d], chr(1)) AS k, CASE WHEN d > 0 THEN array_to_string(w[1:d - 1], chr(1)) END AS pk,
                CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars
         FROM (SELECT conv_id, w, n, unnest(range(0, len(w) + 1)) AS d FROM conv)),
node AS (SELECT d, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends FROM step GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
above AS (SELECT DISTINCT s.d, s.k, a.d AS ad, a.k AS ak FROM step s JOIN step a ON a.conv_id = s.conv_id AND a.d <= s.d),
total AS (SELECT ad AS d, ak AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved
          FROM above JOIN full_ USING (d, k) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN total USING (d, k) LEFT JOIN full_ p ON p.d = f.d - 1 AND p.k = f.pk
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefixtrie.turn_lists(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    nodes = prefixtrie.trie(prefixtrie.with_shared_heads(lists, 100, 5, heads))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# --- conversation structure repair ---------------------------------------------------------------------------------------

# a table over rows and states: o nothing yet, s after the system turn, u after a user turn, d after an answer
REPAIR_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
hurt AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM hurt),
told AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
                row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS again,
                regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
                lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) || left(role, 1) AS pair FROM placed),
rows_ AS (SELECT conv, n, turn, role, text, initial, pair, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated FROM told),
counts AS (SELECT conv, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
                  count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
                  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv),
ins(f, t, x, r) AS (VALUES ('o', 'o', '', []::VARCHAR[]), ('o', 'u', 'I', ['user:']), ('o', 'd', 'II', ['user:', 'assistant:']), ('s', 's', '', []), ('s', 'u', 'I', ['user:']),
  ('s', 'd', 'II', ['user:', 'assistant:']), ('u', 'u', '', []), ('u', 'd', 'I', ['assistant:']), ('d', 'd', '', []), ('d', 'u', 'I', ['user:'])),
mv(f, act, want, t, due) AS (VALUES ('o', 'D', NULL, 'o', NULL), ('s', 'D', NULL, 's', NULL), ('u', 'D', NULL, 'u', NULL), ('d', 'D', NULL, 'd', NULL),
  ('o', 'K', 's', 's', NULL), ('o', 'K', 'u', 'u', NULL), ('s', 'K', 'u', 'u', NULL), ('d', 'K', 'u', 'u', NULL), ('u', 'K', 'a', 'd', NULL),
  ('o', 'R', NULL, 'u', 'user'), ('s', 'R', NULL, 'u', 'user'), ('d', 'R', NULL, 'u', 'user'), ('u', 'R', NULL, 'd', 'assistant')),
best AS (
  SELECT conv, 0::BIGINT AS n, t AS st, 3 * length(x) AS c, x AS a, r FROM (SELECT DISTINCT conv FROM counts), ins WHERE f = 'o'
  UNION ALL
  SELECT conv, n, st, min(c), arg_min(a, lpad(CAST(c AS VARCHAR), 9, '0') || a), arg_min(r, lpad(CAST(c AS VARCHAR), 9, '0') || a)
  FROM (SELECT b.conv, w.n, i.t AS st, b.a || act || i.x AS a,
               b.c + CASE act WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN truncated AND act <> 'D' THEN 3 ELSE 0 END + 3 * length(i.x) AS c,
               list_concat(b.r, CASE WHEN act = 'D' THEN [] ELSE [coalesce(due, w.role) || ':' || w.text] END, i.r) AS r
        FROM best b JOIN rows_ w ON w.conv = b.conv AND w.n = b.n + 1
        JOIN mv ON mv.f = b.st AND (want IS NULL OR want = w.initial) AND (act = 'D' OR NOT (blank OR duplicate)) JOIN ins i ON i.f = mv.t)
  GROUP BY conv, n, st),
done AS (SELECT conv, min(c) AS cost, arg_min(a, lpad(CAST(c AS VARCHAR), 9, '0') || a) AS audit, arg_min(r, lpad(CAST(c AS VARCHAR), 9, '0') || a) AS r
         FROM best JOIN counts USING (conv) WHERE best.n = counts.size AND st IN ('o', 'd') GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv FROM conversations) o LEFT JOIN counts USING (conv) LEFT JOIN done USING (conv)
"""


@query("op13_conversation_repair", REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), copies="copies")
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
