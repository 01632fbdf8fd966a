"""Registered queries of the subpackage: one for each operator, over its
whole table, with the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm import (
    ann,
    bpe,
    decontam,
    langid,
    mixing,
    packing,
    periodic,
    phrases,
    preference,
    quality,
    simhash,
    token_count,
    toxicity,
)
from tierlake.llm.frames import id_crc
from tierlake.session import scratch_path

TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the piece model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of the rows that toxicity may be learnt from."""
    return table(spark, sf_dir, "labels").where(id_crc() % 5 != 0).groupBy("doc_id").agg(
        F.max("toxic").alias("label"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxic_labels(spark, sf_dir))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [r.name for r in quality.plan(docs)]
    measured = quality.with_measures(docs)
    rules = {r.name: r for r in quality.default_rules(measured=True)}
    verdict = quality.cascade([rules[name] for name in order])
    base = rules["few_words"].hit() | rules["repeated_words"].hit()
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           base.alias("base_failed"), verdict.isNull().alias("kept"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen one of a pair. The rejected one has
    the same turns but the last, which is the last of the next conversation
    (by id; none where that is missing)."""
    whole = preference.gathered(table(spark, sf_dir, "conversations"))
    # Never NULL, so that both sides of the join read one exchange.
    before = F.coalesce(F.try_subtract("conv_id", F.lit(1)), F.lit(2**63 - 1))
    other = whole.select(before.alias("conv_id"), F.slice("turns", -1, 1).alias("other"))
    last = F.coalesce("other", F.slice("turns", 1, 0))
    rejected = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), last)
    pairs = whole.join(other, "conv_id", "left").select("conv_id", "turns", rejected.alias("rejected"))
    return preference.format_sides(pairs, "conv_id", "turns", "rejected")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = simhash.fingerprints(docs, shingle=4, seed=42).select("doc_id", "fp")
    found = simhash.near_duplicates(prints, radius=4)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.decide(docs).select("doc_id", "size", "source_size", "target",
                                      (F.col("copies") * F.col("size")).alias("taken"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(id_crc() % 4 != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the files they were written to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "token-files")
    packing.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return packing.read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 first phrases of each language."""
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.mine(docs, least=100, most=2000, percent=100)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and whose they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document (a tenth of them with a planted one)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted().alias("text"))
    found = periodic.find_runs(docs, least=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("m.length"), -F.col("m.shorter")
    return found.withColumn("m", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.back")).alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_token_count, op2_toxicity, op3_quality_rules, op4_learned_partitions, op5_preference,
    op6_byte_bpe, op7_simhash, op8_mixing, op9_language, op10_token_files, op11_collocations, op12_decontamination,
    op13_periodic_runs)}

ORACLE_SQL = {
    "op3_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
windows AS (
  SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM windows WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS capitals,
         length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * capitals > 50 * word_chars) AS kept
FROM m
""",
    "op5_preference": r"""
WITH w AS (
  SELECT conv_id AS pair_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'),
                            coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS turns
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT pair_id, true AS chosen, role, text, pos FROM w
  UNION ALL SELECT pair_id, false, role, text, pos FROM w WHERE pos < turns
  UNION ALL SELECT a.pair_id, false, b.role, b.text, a.pos
  FROM w a JOIN w b ON b.pair_id = a.pair_id + 1 WHERE a.pos = a.turns AND b.pos = b.turns),
p AS (SELECT pair_id, max(pos) FILTER (chosen) AS nc, max(pos) FILTER (NOT chosen) AS nr FROM t GROUP BY pair_id),
differ AS (
  SELECT a.pair_id, min(a.pos) AS pos
  FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.chosen AND NOT b.chosen
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
n AS (
  SELECT p.pair_id, coalesce(differ.pos - 1, least(coalesce(nc, 0), coalesce(nr, 0))) AS n
  FROM p LEFT JOIN differ USING (pair_id)),
r AS (
  SELECT t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id)),
s AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, chosen, pos > n ORDER BY pos) AS upto FROM r),
x AS (
  SELECT *, CASE WHEN role = 'assistant' AND pos > n
            THEN (upto - length(text) - 8)::BIGINT || ':' || (upto - 1)::BIGINT END AS span FROM s)
SELECT pair_id, CAST(any_value(n) AS INTEGER) AS prefix_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (chosen AND pos <= n), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (chosen AND pos > n), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (chosen AND span IS NOT NULL), '') AS chosen_spans,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (NOT chosen AND pos > n), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT chosen AND span IS NOT NULL), '') AS rejected_spans
FROM x GROUP BY pair_id
""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
         lambda w: w <> '')) AS BIGINT) AS size FROM documents),
e AS (
  SELECT source, doc_id, size, count(*) AS rows, count(*) * size AS total,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key FROM d GROUP BY source, doc_id, size),
s AS (
  SELECT source, CAST(sum(total) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM e GROUP BY source),
f AS (SELECT *, source_size * 2 AS cap, source_size * 2 / weight AS fill FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce(max(level) FILTER (fill >= level) OVER () * weight, cap::DOUBLE)) AS target FROM l),
m AS (
  SELECT *, sum(total) OVER (PARTITION BY source ORDER BY key, doc_id, size) - total AS start,
         (rows + 999) // 1000 AS step
  FROM e WHERE total > 0),
h AS (SELECT * REPLACE (least(step, rows - part * step) AS rows)
      FROM (SELECT *, unnest(range((rows + step - 1) // step)) AS part FROM m)),
q AS (
  SELECT h.source, doc_id, size, key, rows, rows * size AS total, t.source_size, t.target,
         start + size * (part * step + rows) AS cum
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, (cum + epoch * source_size) / target AS finish FROM q, (SELECT unnest([0, 1]) AS epoch) WHERE target > 0),
c AS (
  SELECT *, sum(total) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, size) AS upto FROM v),
b AS (SELECT CAST(floor(sum(source_size) * 1.5) AS BIGINT) AS budget FROM t),
k AS (
  SELECT source, doc_id, size,
         CAST(sum(least(rows, greatest(budget - (upto - total), 0) // size)) AS BIGINT) AS fit
  FROM c, b GROUP BY source, doc_id, size),
o AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) AS i,
         count(*) OVER (PARTITION BY source, doc_id, size) AS n FROM d)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(coalesce(k.fit // n + CASE WHEN i <= k.fit % n THEN 1 ELSE 0 END, 0) * d.size AS BIGINT) AS taken
FROM o AS d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.size = d.size
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, size, array_to_string(s, ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, size, list_slice(w, i, i + size - 1) AS s
        FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS size)))
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a FROM g WHERE size > 1 AND f >= 100),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS x WHERE x.lang = c.lang AND x.size > c.size AND 100 * x.a >= 100 * c.a
    AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM kept),
s AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n.n,
         (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN n ON n.lang = cuts.lang
  JOIN g AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[:k], ' ')
  JOIN g AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score::BIGINT AS score
FROM s QUALIFY rank <= 2000
""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
hits AS (
  SELECT rid, i, size, item FROM (
    SELECT rid, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
    FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM d, (SELECT DISTINCT size FROM windows)))
  JOIN windows USING (size, words)),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i, unnest(range(size)) AS k FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
""",
}
