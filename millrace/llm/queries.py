"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, minhash, mixing, negatives, neighbours, repeats, sharding, spelling, tokens, toxicity
from .common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""
WITH RECURSIVE spoken AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM spoken),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON x = doc_id
""")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query(r"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS participant FROM spoken WHERE role <> 'system'),
pieces AS (
  SELECT p.conv_id, p.participant, s.role,
    row_number() OVER (PARTITION BY p.conv_id, p.participant ORDER BY s.turn, s.role, md5(s.text)) - 1 AS position,
    '<|im_start|>' || CASE WHEN s.role = p.participant THEN 'assistant' WHEN s.role = 'system' THEN 'system'
      ELSE 'user name=' || regexp_replace(regexp_replace(s.role, '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g'), '[\r\n]', ' ', 'g') END || chr(10) AS head,
    regexp_replace(s.text, '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g') || '<|im_end|>' || chr(10) AS tail
  FROM people p JOIN spoken s ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, CAST(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, participant ORDER BY position) AS BIGINT) AS piece_end
  FROM pieces)
SELECT conv_id, participant, position, role, head || tail AS piece,
  piece_end - length(head) - length(tail) AS piece_start, piece_end,
  CASE WHEN role = participant THEN piece_end - length(tail) END AS mask_start,
  CASE WHEN role = participant THEN piece_end - 1 END AS mask_end
FROM placed
""")
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """A public vocabulary's file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query()
def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    written = tokens.encode(table(spark, sf_dir, "documents"), lambda: tokens.byte_pairs(path, pattern))
    return tokens.counted(Scratch(spark).store(written, "tokens"))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # Read by several passes: the words of a text are counted once.
    mixed = mixing.mix(Scratch(spark).store(mixing.measure(docs).drop("text"), "mix-measured"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query(rf"""
WITH item_words AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[i : i + least(13, len(w)) - 1] AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM doc_words, (SELECT DISTINCT len(g) AS n FROM windows) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM places JOIN windows ON w[i : i + n - 1] = g),
counted AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "p_poor", "p_toxic", F.col("rejected").alias("toxic"))


@query()
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = vocabulary("word_bpe_49k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    read = bpe.decode(coded, path, text="decoded")
    return read.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)
