"""The operators' registered queries, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm import (
    decontaminate, fill_in_middle, lexical, line_dedup, lm, mixing, neighbours, quality, sentence_pieces, sharding, simhash, token_counts, toxicity)
from grainwise.llm.common import keep, remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(fn: Query) -> Query:
    """Registers a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    draw = mixing.random_number(F.col("doc_id"), F.col("source"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = keep(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), draw.alias("draw")))
    mixed = mixing.mix_sources(sized, "source", F.col("size"), F.col("draw"))
    return mixed.select("doc_id", *[f"mix.{c}" for c in ("size", "source_size", "target", "taken")])


ORACLES["op1_mix_sources"] = """
WITH docs AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''),
      md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS draw
  FROM documents),
sized AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS merit FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS s,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
shares AS (
  SELECT *, ((sum(s) OVER ())::BIGINT - 3 * coalesce(sum(s) OVER before, 0)::BIGINT)
      / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT)::DOUBLE AS share
  FROM sources WINDOW before AS (ORDER BY s / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, s, CASE WHEN share * w > 3 * s THEN s * 3.0::DOUBLE
    ELSE (SELECT arg_min(share, s / w::DOUBLE) FROM shares WHERE NOT share * w > 3 * s) * w END AS target FROM shares),
classes AS (
  SELECT z.source, merit, sum(size)::BIGINT AS words, any_value(target) AS target, any_value(s) AS s
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source GROUP BY z.source, merit),
rates AS (
  SELECT *, CASE WHEN mass_left = 0 THEN NULL ELSE (target - 3 * held) / mass_left END AS rate FROM (
    SELECT *, coalesce(sum(words) OVER above, 0)::BIGINT AS held,
      (sum(merit * words) OVER (PARTITION BY source) - coalesce(sum(merit * words) OVER above, 0))::BIGINT AS mass_left
    FROM classes WINDOW above AS (PARTITION BY source ORDER BY merit DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
planned AS (
  SELECT source, merit, words, s, target, CASE WHEN rate * merit >= 3 THEN 3.0::DOUBLE ELSE
    coalesce(arg_max(rate, merit) FILTER (WHERE rate * merit < 3) OVER (PARTITION BY source) * merit, 0) END AS expected FROM rates),
wanted AS (SELECT source, max(target) - sum(floor(expected) * words) AS wanted FROM planned GROUP BY source),
ranked AS (
  SELECT z.doc_id, z.source, z.size, p.s, p.target, floor(expected) AS base, expected - floor(expected) AS chance, wanted,
    CASE WHEN expected > floor(expected) THEN draw / (1 - draw) * ((1 - (expected - floor(expected))) / (expected - floor(expected))) END AS odds
  FROM sized z JOIN planned p ON z.source IS NOT DISTINCT FROM p.source AND z.merit = p.merit
  JOIN wanted w ON z.source IS NOT DISTINCT FROM w.source),
steps AS (
  SELECT *, sum(size) OVER (PARTITION BY source, chance > 0 ORDER BY odds / (1 + odds) RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY source, odds / (1 + odds)) AS here FROM ranked)
SELECT doc_id, size, s AS source_size, target,
  (size * (CASE WHEN size > 0 THEN base + CASE WHEN chance > 0 AND 2 * (upto - here) + here <= 2 * wanted THEN 1 ELSE 0 END ELSE 0 END))::BIGINT AS taken
FROM steps
"""


@query
def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), lm.FOLDS) == lm.HELD_OUT
    scored = lm.score(docs, lm.learn(docs, lm.training_fold("doc_id")))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of a benchmark passage in a document, of short ones too."""
    return decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"), short=True)


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The histogram of encoded lengths with the answers for every context limit."""
    docs = table(spark, folder, "documents").select("text")
    return token_counts.histogram(token_counts.with_length(docs, token_counts.read_ranks()))


@query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=3, bits=3)


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its lines, those that stay, and the md5 of the text that is left."""
    cut = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "lines", "kept_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op7_line_dedup"] = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM docs),
worded AS (SELECT *, [x FOR x IN regexp_split_to_array(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+') IF x <> ''] AS w FROM lines),
firsts AS (SELECT doc_id, n, w FROM worded WHERE len(w) > 0 QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, n) = 1),
variants AS (
  SELECT doc_id, n, md5(array_to_string(w[1:i], ' ')) AS front, md5(array_to_string(w[i + 1:], ' ')) AS back
  FROM (SELECT *, unnest(range(0, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 4)
  UNION ALL
  SELECT doc_id, n, md5(array_to_string(w[1:i], ' ')), md5(array_to_string(w[i + 2:], ' '))
  FROM (SELECT *, unnest(range(0, len(w))) AS i FROM firsts WHERE len(w) >= 5)),
near AS (SELECT DISTINCT doc_id, n FROM (
  SELECT doc_id, n, row_number() OVER (PARTITION BY front, back ORDER BY doc_id, n) AS place FROM variants) WHERE place > 1),
kept AS (SELECT doc_id, n FROM firsts EXCEPT SELECT doc_id, n FROM near)
SELECT l.doc_id, count(*) FILTER (WHERE len(w) > 0)::INT AS lines, count(k.n)::INT AS kept_lines,
  md5(coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (WHERE len(w) = 0 OR k.n IS NOT NULL), '')) AS text_md5
FROM worded l LEFT JOIN kept k ON l.doc_id = k.doc_id AND l.n = k.n GROUP BY l.doc_id
"""


@query
def op8_shard(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = keep(table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")))
    return sharding.shard_rows(rows, "doc_id", 16)


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    held_out = remainder(F.col("doc_id"), toxicity.FOLDS) == 0
    return toxicity.toxicity(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    weak, scorer = quality.learn(docs)
    return quality.quality(docs, weak, scorer).select("doc_id", "weak_label", "score", "keep")


@query
def op11_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = sentence_pieces.read_vocabulary()
    ids = sentence_pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary)
    both = sentence_pieces.decode(ids, vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical.build_index(table(spark, folder, "documents"))
    return lexical.search(index, table(spark, folder, "benchmark"), k=50)


ORACLES["op12_lexical_search"] = """
WITH doc_terms AS (
  SELECT row, doc_id, term, count(*) AS tf FROM (
    SELECT row, doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)) GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY row),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM doc_terms, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
norms AS (SELECT row, 50 + (50 * n * docs) // terms AS m FROM lengths, totals),
scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN doc_terms USING (term) JOIN norms USING (row)
  GROUP BY item_id, row, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
