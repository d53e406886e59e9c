"""Registered queries of the operators, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, forest, licenses, minhash, mixing, packing, repair, repeats, substrings, token_counts, topk, toxicity, trie
from recordloom.llm.sequences import digest_sorted
from recordloom.session import stage

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded, as digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", WORD_VOCABULARY)
    both = bpe.decode(ids, "doc_id", "ids", WORD_VOCABULARY)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of ``documents``; a token counts where its first character lies."""
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.count_tokens(docs, "doc_id", "text", BYTE_VOCABULARY)
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into windows of 2,048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_VOCABULARY, end=1, window=2048)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence wording in ``documents``: places of the base phrases, labels of both kinds."""
    found = licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"), "score",
    )


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def toxicity_weights(spark: SparkSession, docs: DataFrame, sf_dir: str):
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return toxicity.fit(docs, "doc_id", "text", labels, "toxic")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` scored by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, "doc_id", "text", toxicity_weights(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the words of repeated windows of 35 words."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", length=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the bytes of repeated strings of 400 bytes."""
    cut = repeats.remove_repeated_bytes(table(spark, sf_dir, "documents"), "doc_id", "text", length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def every_fiftieth(df: DataFrame) -> Column:
    return df["vec_id"] % 50 == 0


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of ``embeddings`` by the inner product of 256 times their components, rounded down."""
    df = table(spark, sf_dir, "embeddings")
    return topk.search(df, "vec_id", "embedding", every_fiftieth(df), 5, weight=lambda x: F.floor(256 * x).cast("double"))


SQL["op5_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of ``embeddings`` by cosine that the forest finds."""
    df = table(spark, sf_dir, "embeddings")
    return forest.search(df, "vec_id", "embedding", every_fiftieth(df), 5)


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by 80 percent of their pairs of words."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def spliced(conversations: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the one whose key is the next multiple of 20 towards zero."""
    heads = conversations.select(F.col("key").alias("base"), F.slice("turns", 1, 3).alias("head"))
    head_turns = (F.crc32(F.col("key").cast("string").cast("binary")) % 4).cast("int")
    rows = conversations.withColumn("base", F.col("key") - F.col("key") % 20).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), head_turns), F.slice("turns", 1, 0))
    rest = F.slice("turns", head_turns + 1, F.greatest(F.size("turns") - head_turns, F.lit(0)))
    return rows.select("key", F.concat(head, rest).alias("turns"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of ``conversations`` with spliced heads."""
    found = trie.trie(spliced(trie.paths(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")))
    return found.withColumnsRenamed({"low": "conv_id", "parent": "parent_conv_id"})


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with rows dropped, emptied, stripped, repeated or given to the user, by a checksum of their keys."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), damage.alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``conversations`` after damage."""
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    columns = ("conv_id", "turn", "role", "text")
    plans = stage(repair.plan_repairs(rows, *columns), "repairs")
    turns = repair.repaired(rows, plans, *columns)
    digests = digest_sorted(turns.select("key", F.concat("role", F.lit(":"), "text").alias("piece")), "\n")
    keys = given.select("conv_id").distinct()
    both = keys.join(plans, keys["conv_id"].eqNullSafe(plans["key"]), "left").drop("key")
    both = both.join(digests, both["conv_id"].eqNullSafe(digests["key"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(trie.EMPTY)).alias("repaired_sha256"),
    )


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by source to weights 1, 2, 3."""
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


_WORDS = "list_filter(string_split_regex({}, '[ \\t-\\r]+'), lambda x: x <> '')"

SQL["op8_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM g),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
e AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT e.r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c USING (r, p) GROUP BY e.r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

SQL["op10_near_duplicates"] = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
"""

_COUNT = "len(regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+'))"

SQL["op13_mixing"] = f"""
WITH d AS (
    SELECT doc_id, source, {_COUNT.format("text")} AS size,
        -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT)::DOUBLE + 1) / {float(16**13 + 1)}::DOUBLE)
        / greatest(length(translate(coalesce(text, ''), '{mixing.NO_PROSE.replace("'", "''")}', '')) / greatest(length(coalesce(text, '')), 1)::DOUBLE, 0.05) AS k
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST)
), m AS (SELECT min_by(level, 3 * source_size / w) AS level FROM l WHERE w * level < 3 * source_size),
t AS (
    SELECT l.source, source_size, least(3.0 * source_size, coalesce(w * m.level, 3.0 * source_size))::DOUBLE AS target FROM l LEFT JOIN m ON true
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs, round(target)::BIGINT AS budget FROM t
)
SELECT doc_id, size, source_size, target,
    epochs * size + greatest(0, least(size, budget - epochs * source_size
        - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

#: The checksum of the decimal digits of a key, bit by bit.
_CRC = """4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))"""

SQL["op11_conversation_trie"] = f"""
WITH r AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, ({_CRC.format("conv_id")}) % 4 AS h FROM (SELECT DISTINCT conv_id FROM r)),
t AS (
    SELECT c.conv_id, r.p, role, text FROM c JOIN r ON r.conv_id = c.conv_id - c.conv_id % 20 AND r.p <= h
    UNION ALL
    SELECT c.conv_id, r.p, role, text FROM c JOIN r ON r.conv_id = c.conv_id AND r.p > h
), k AS (
    SELECT conv_id, row_number() OVER q AS d, {_COUNT.format("text")} AS w,
        md5(string_agg(md5(length(role) || ':' || role || text), ',') OVER q) AS node
    FROM t WINDOW q AS (PARTITION BY conv_id ORDER BY p)
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), g AS (
    SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS up, max(d) OVER (PARTITION BY conv_id) AS len,
        sum(w) OVER (PARTITION BY conv_id ORDER BY d DESC) AS below
    FROM k
), n AS (
    SELECT node, d, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS low, count(*) AS n_convs, sum(below) AS below,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len), '')) AS ends_sha256
    FROM g GROUP BY node, d
), ch AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (node, d)),
o AS (
    SELECT g.node, g.d, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, sum(y.w) AS own
    FROM g JOIN (SELECT g.conv_id, g.d, x.w, x.n_children FROM g JOIN x ON x.node = g.node AND x.d = g.d AND x.low = g.conv_id) y
        ON y.conv_id = g.conv_id AND y.d >= g.d
    GROUP BY ALL
)
SELECT x.low AS conv_id, x.d::BIGINT AS depth, z.low AS parent_conv_id, x.n_convs, x.n_children, o.n_leaves,
    (x.below - o.own)::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN o ON o.node = x.node AND o.d = x.d LEFT JOIN x z ON z.node = x.up AND z.d = x.d - 1
"""
