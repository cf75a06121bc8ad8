"""Registered queries of this subpackage and the SQL of those that SQL expresses.

Each query applies its operator, with production parameters, to its whole table
and returns the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acqlens.llm import chat, collocations, decontaminate, lattice, licenses, mixing, neardup, packing, pages, periods, quality, secrets, urls
from acqlens.llm.storage import table

# The url rules of op2 and the conversation that op1 adds.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
ADDED_TEXT = "</s>[INST] ok [/INST]"
HELD_OUT_FOLD, FOLDS = 2, 7


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", ADDED_TEXT), (-1, 1, "assistant", ADDED_TEXT)],
                                  "conv_id bigint, turn bigint, role string, text string")
    parts = turns.union(added).withColumn("parts", chat.text_part(F.col("text")))
    return chat.read_back(chat.format_turns(parts))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("spans", lambda s: s.kind != "random")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality.COUNTS[:5], "base_failed", "kept", "quality")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op8_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    return lattice.scored(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), held_out)


def op9_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def repeated_tails(ids: list, first: np.ndarray) -> np.ndarray:
    """op13's rewriting: in documents with h % 10 = 0 the words from ``a`` on repeat the first p of them (ids that are null: none)."""
    source = np.arange(int(first[-1]))
    for d, doc in enumerate(ids):
        begin, n = int(first[d]), int(first[d + 1] - first[d])
        if doc is None or not n or (h := crc32(str(doc).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[begin + a : begin + n] = begin + a + np.arange(n - a) % p
    return source


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(table(spark, sf_dir, "documents"), moved=repeated_tails)
    best = F.expr("""
        array_sort(runs, (x, y) -> case
          when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1)
          when x.start <> y.start then if(x.start < y.start, -1, 1)
          when x.period <> y.period then if(x.period < y.period, -1, 1) else 0 end)""")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat_formatting, op2_url_filter, op3_secret_scan, op4_quality_rules, op5_benchmark_decontamination,
    op6_ngram_jaccard_join, op7_packing, op8_lattice_scoring, op9_page_differencing, op10_license_scan,
    op11_collocation_mining, op12_source_mixing, op13_periodic_runs)}


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ADDED_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.TURN + chat.SAYS + chat.DONE)}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM turns GROUP BY conv_id
"""


def _op2_sql() -> str:
    """Rules, then the two walks: every round's share of the ranks, until it is too small to matter, and their sum."""
    host = lambda c: f"translate(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"
    fits = {text: f"((host = '{text.split('/')[0]}' OR ends_with(host, '.{text.split('/')[0]}')) "
                  f"AND starts_with(path, '/{text.split('/', 1)[1]}'))" for _, text in URL_RULES}
    longest = sorted(URL_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits[text]} THEN '{text}'" for _, text in longest)
    verdict = " ".join(f"WHEN {fits[text]} THEN '{kind}'" for kind, text in longest)
    link = r"""(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]*)"""
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, coalesce({host('url')}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages
), ruled AS (
  SELECT page_id, host, path, html, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM parsed
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM ruled
), edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, {host("CASE WHEN link LIKE '//%' THEN 'http:' || link ELSE link END")} AS dst FROM links)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), walks AS (
  SELECT 0 AS walk, src, dst, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges
), steps AS (
  SELECT walk, src, dst, n / sum(n) OVER (PARTITION BY walk, src) AS share FROM walks
), seeds AS (
  SELECT 0 AS walk, host, CAST(count(*) AS DOUBLE) AS mass FROM ruled WHERE by_rule = 'allow' GROUP BY host
  UNION ALL SELECT 1, host, count(*) FROM ruled WHERE by_rule = 'block' GROUP BY host
), added AS (
  SELECT 0 AS round, walk, host, mass * {1 - urls.DAMPING} AS mass FROM seeds
  UNION ALL
  SELECT any_value(a.round) + 1, a.walk, s.dst, sum(a.mass * s.share * {urls.DAMPING})
  FROM added a JOIN steps s ON s.walk = a.walk AND s.src = a.host WHERE a.round < 400 GROUP BY a.walk, s.dst
), scores AS (
  SELECT host, coalesce(sum(mass) FILTER (walk = 0), 0) AS trust, coalesce(sum(mass) FILTER (walk = 1), 0) AS distrust
  FROM added GROUP BY host
)
SELECT page_id, r.host AS host, path, rule,
  coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > {urls.RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN scores s ON r.host = s.host
"""


# Shingles of a table as (id, key): five words in a row, as text.
def _shingles_sql(name: str, id_col: str) -> str:
    return f"""
  SELECT DISTINCT id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS key
  FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS i
        FROM (SELECT {id_col} AS id, regexp_extract_all(lower(text), '(?:[0-9a-z]|[^\\x00-\\x7F])+') AS w FROM {name}))"""


OP5_SQL = f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}), b AS ({_shingles_sql("benchmark", "item_id")}),
size AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) / any_value(n) AS containment
FROM d JOIN b USING (key) JOIN size ON size.id = b.id GROUP BY d.id, b.id HAVING count(*) / any_value(n) >= {decontaminate.CONTAINMENT}
"""

# Every phrase of one to five words, counted; then scores of the frequent ones by their cuts.
OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words
), grams AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m, count(*) AS n
  FROM places, (SELECT unnest(generate_series(1, {collocations.LONGEST})) AS m) WHERE i + m - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= {collocations.LEAST}
), totals AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), found AS (
  SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE m > 1
), dropped AS (
  SELECT DISTINCT s.lang, s.phrase FROM found s JOIN found l ON s.lang = l.lang AND l.m > s.m AND 100 * l.n >= 100 * s.n
    AND contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' ')
), cuts AS (
  SELECT lang, phrase, m, n, w, unnest(generate_series(1, m - 1)) AS k FROM found ANTI JOIN dropped USING (lang, phrase)
), scored AS (
  SELECT c.lang, c.phrase, k, c.n AS a, l.n AS l, r.n AS r, t.n AS n,
    CAST(CAST({collocations.SCALE} AS HUGEINT) * c.n * t.n // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {collocations.TOP}
"""

# Targets by their level in one sort, all quotients ranked, blocks one by one.
OP12_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST({mixing.CAP} * sum(size) AS BIGINT) AS most,
    list_value{mixing.WEIGHTS}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INTEGER) + 1] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, row_number() OVER by_stop AS place, CAST((SELECT sum(source_size) FROM sources)
      - coalesce(sum(most) OVER (by_stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (by_stop ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW by_stop AS (ORDER BY most / weight, source)
), reached AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= most
), aims AS (
  SELECT source, source_size, CASE WHEN r.level * weight > most THEN CAST(most AS DOUBLE) ELSE r.level * weight END AS target
  FROM sources, reached r
), copied AS (
  SELECT source, doc_id, size, count(*) AS copies,
    least(CAST(ceil(count(*) * size / {mixing.SHARD_WORDS}) AS BIGINT), count(*)) AS chunks
  FROM sized WHERE size > 0 GROUP BY source, doc_id, size
), items AS (
  SELECT *, unnest(generate_series(0, chunks - 1)) AS chunk FROM copied
), hashed AS (
  SELECT i.*, size * (copies // chunks + CASE WHEN chunk < copies % chunks THEN 1 ELSE 0 END) AS words, source_size, target,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || chunk) AS place
  FROM items i JOIN aims a ON i.source IS NOT DISTINCT FROM a.source
), dealt AS (
  SELECT *, CAST('0x' || place[1:8] AS BIGINT) % CAST(ceil(source_size / {mixing.SHARD_WORDS}) AS BIGINT) AS shard FROM hashed
), laid AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size, chunk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
    md5(hex(coalesce(source, '')) || ':' || CAST(source IS NULL AS VARCHAR) || ':' || shard) AS shard_key
  FROM dealt
), shards AS (
  SELECT shard_key, greatest(CAST(sum(words) AS BIGINT) // {mixing.BLOCK_WORDS}, 1) AS blocks,
    any_value(target) * greatest(CAST(sum(words) AS BIGINT) // {mixing.BLOCK_WORDS}, 1) / any_value(source_size) AS claim
  FROM laid GROUP BY shard_key
), offers AS (
  SELECT shard_key, claim, unnest(generate_series(0, {mixing.CAP} * blocks - 1)) AS k FROM shards WHERE claim > 0
), ranked AS (
  SELECT shard_key, row_number() OVER (ORDER BY (2 * k + 1) / (2 * claim), shard_key) AS rank FROM offers
), quotas AS (
  SELECT s.shard_key, blocks, count(rank) AS seats, CAST('0x' || s.shard_key[1:12] AS BIGINT) AS number
  FROM shards s LEFT JOIN ranked r ON r.shard_key = s.shard_key AND rank <= CAST(floor((SELECT sum(claim) FROM shards) + 1e-6) AS BIGINT)
  GROUP BY s.shard_key, blocks
), permuted AS (
  SELECT *, list_value{mixing.STRIDES}[CAST(number % {len(mixing.STRIDES)} AS INTEGER) + 1] % blocks AS stride FROM quotas
), blocks AS (
  SELECT source, doc_id, size, copies, words, stop - words AS start, stop, blocks, seats, stride, number,
    unnest(generate_series(least((stop - words) // {mixing.BLOCK_WORDS}, blocks - 1), least((stop - 1) // {mixing.BLOCK_WORDS}, blocks - 1))) AS i
  FROM laid JOIN permuted USING (shard_key)
), taken AS (
  SELECT source, doc_id, size, copies, sum(
    (least(stop, CASE WHEN i = blocks - 1 THEN stop ELSE (i + 1) * {mixing.BLOCK_WORDS} END) - greatest(start, i * {mixing.BLOCK_WORDS}))
    * (seats // blocks + CASE WHEN (i * stride + number % blocks) % blocks < seats % blocks THEN 1 ELSE 0 END)) AS taken
  FROM blocks GROUP BY source, doc_id, size, copies
)
SELECT s.doc_id, s.size, a.source_size, a.target, CAST(coalesce(t.taken // t.copies, 0) AS BIGINT) AS taken
FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
LEFT JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.size = t.size
"""

SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op2_url_filter": _op2_sql(), "op5_benchmark_decontamination": OP5_SQL,
                       "op11_collocation_mining": OP11_SQL, "op12_source_mixing": OP12_SQL}

