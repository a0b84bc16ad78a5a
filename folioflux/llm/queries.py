"""The registered queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.llm import decontam, licenses, lm, minhash, residual_pack, sharding, token_pack, topk, toxicity, url_filter
from folioflux.llm.shared import keep
from folioflux.operators.kept import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Dated rows of two lists: (list_name, kind, entry, action, listed_at).
URL_LISTS = [
    ("unsafe", "domain", "ads-track.example.com", "block", "2024-02-01 00:00:00"),
    ("unsafe", "domain", "casino-win.example.net", "block", "2024-01-15 00:00:00"),
    ("unsafe", "domain", "casino-win.example.net", "remove", "2024-06-01 00:00:00"),
    ("unsafe", "domain", "casino-win.example.net", "block", "2024-09-10 12:00:00"),
    ("unsafe", "domain", "spam-farm.example.org", "block", "2024-03-20 00:00:00"),
    ("unsafe", "domain", "adult-x.example.com", "block", "2023-12-01 00:00:00"),
    ("unsafe", "domain", "cheap-pills.example.net", "block", "2024-05-05 06:30:00"),
    ("unsafe", "domain", "cheap-pills.example.net", "remove", "2024-11-01 00:00:00"),
    ("unsafe", "domain", "free-bets.example.net", "block", "2024-04-01 00:00:00"),
    ("unsafe", "domain", "free-bets.example.com", "block", "2024-04-01 00:00:00"),
    ("unsafe", "prefix", "tionsh.example.net/fr/", "block", "2024-07-01 00:00:00"),
    ("reviewed", "host", "www.ads-track.example.com", "allow", "2024-08-01 00:00:00"),
    ("reviewed", "host", "m.free-bets.example.com", "allow", "2024-06-15 00:00:00"),
    ("reviewed", "host", "m.free-bets.example.com", "remove", "2024-10-15 00:00:00"),
    ("reviewed", "prefix", "tionsh.example.net/fr/2", "allow", "2024-09-01 00:00:00"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the lists as they were when each page was fetched; page_id stands for the minute of 2024, every 37 minutes."""
    dated = [(*row[:4], int(datetime.fromisoformat(row[4]).replace(tzinfo=timezone.utc).timestamp())) for row in URL_LISTS]
    entries = spark.createDataFrame(dated, "list_name string, kind string, entry string, action string, listed_at long")
    entries = entries.withColumn("listed_at", F.timestamp_seconds("listed_at"))
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37 * 60, F.lit(366 * 86400)))
    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", fetched.alias("fetched_at"))
    found = url_filter.filter_urls(captures, entries)
    kept = "host", "n_active", "decision", "list_name", "kind", "entry"
    return found.select("page_id", F.unix_timestamp("fetched_at").alias("fetched_s"), *[F.col(f"url_filter.{c}") for c in kept], F.unix_timestamp("url_filter.valid_from").alias("valid_from_s"))


def _op1_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in URL_LISTS)
    return rf"""
WITH lists AS (SELECT list_name, kind, entry, action, epoch(CAST(listed_at AS TIMESTAMP))::BIGINT AS valid_from FROM (VALUES {rows}) t(list_name, kind, entry, action, listed_at)),
valid AS (SELECT *, lead(valid_from) OVER (PARTITION BY list_name, kind, entry ORDER BY valid_from) AS valid_to FROM lists),
captures AS (
  SELECT page_id, 1704067200 + (page_id * 37 * 60) % (366 * 86400) AS fetched_s,
    lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/:?#]+([^#]*)', 1) AS path FROM pages),
hits AS (
  SELECT page_id, v.*, row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(entry) DESC, CASE action WHEN 'block' THEN 0 ELSE 1 END, list_name) AS nth,
    count(*) OVER (PARTITION BY page_id) AS n_active
  FROM captures c JOIN valid v ON v.action <> 'remove' AND c.fetched_s >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_s < v.valid_to)
    AND CASE v.kind WHEN 'host' THEN c.host = v.entry WHEN 'domain' THEN c.host = v.entry OR ends_with(c.host, '.' || v.entry) ELSE starts_with(c.host || c.path, v.entry) END)
SELECT c.page_id, c.fetched_s, c.host, coalesce(h.n_active, 0)::INTEGER AS n_active, coalesce(h.action, 'pass') AS decision, h.list_name, h.kind, h.entry, h.valid_from AS valid_from_s
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.nth = 1"""


SHARDS = 40


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    sharded = sharding.histogram_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), SHARDS, carried=["doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: A document is predicted toxic from this score on.
TOXIC_FROM = 0.3


def toxicity_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents that aren't held out."""
    return toxicity.train(documents.where(toxicity.learnable(F.col("doc_id"))), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the two dictionaries."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity_model(spark, documents, sf_dir))
    return scored.select("doc_id", (~toxicity.learnable(F.col("doc_id"))).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= TOXIC_FROM).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 token ids, with cumulative segment lengths and position resets."""
    return token_pack.pack_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a trie of n-grams that is built from those that aren't held out."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    known = lm.learnable(F.col("doc_id"))
    trie = lm.train(documents.where(known))
    scored = lm.score(documents, trie)
    return scored.select("doc_id", (~known).alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 2-word shingles reach a Jaccard similarity of 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


_OP6_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
n AS (SELECT doc_id, s, len(s) AS n FROM s),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS common FROM n x JOIN n y ON x.doc_id < y.doc_id AND x.n > 0 AND y.n > 0 AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)) WHERE 100 * common >= 80 * (total - common)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other vectors for every 100th vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


_OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the 10-word windows of all benchmark items."""
    found = decontam.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join("contamination.items", ",")
    return found.select(
        "doc_id", "contamination.n_words", "contamination.n_hit", F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: places of the base phrases, and all labels that the scan finds."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    places, at = F.col("licenses.places"), F.transform("licenses.places", lambda p: p["first_word"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "licenses.n_words", F.size(places).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(F.transform(places, lambda p: p["label"])).alias("base_labels"), joined(F.col("licenses.labels")).alias("labels"), F.col("licenses.score").alias("score"),
    )


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    packed = residual_pack.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# What SQL can say of queries that it can't express as a whole: the same operators over the same tables.


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's rows: whether its shard is as near to equal bytes as tolerance and the longest text allow, and its slots are gapless."""
    rows = keep(op2_sharding(spark, sf_dir), "shard-law")
    whole = rows.agg(F.sum("size").alias("total"), F.max("size").alias("longest"))
    of_shard = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).crossJoin(F.broadcast(whole))
    ideal = F.col("total") / SHARDS
    marks = of_shard.select("shard", (F.abs(F.col("bytes") - ideal) <= 0.02 * ideal + 2 * F.col("longest")).alias("near"), ((F.col("n") == F.col("slots")) & (F.col("last") == F.col("n") - 1)).alias("gapless"))
    return rows.join(marks, "shard").select("doc_id", "size", "law", (F.col("shard").between(0, SHARDS - 1)).alias("known"), "near", "gapless")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's counts and base scores."""
    return op5_lm_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's base columns."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def packing_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's documents: whether their pieces are whole, and their sequences gapless and of at most 1024 tokens."""
    rows = keep(op10_residual_packing(spark, sf_dir), "packing-law")
    following = F.lead("offset").over(Window.partitionBy("sequence_id").orderBy("offset"))
    end = F.col("offset") + F.col("length")
    placed = rows.withColumn("good", F.when(following.isNull(), end <= 1024).otherwise(end == following)).withColumn("first", F.min("offset").over(Window.partitionBy("sequence_id")))
    return placed.groupBy("doc_id").agg(
        F.bool_and(F.col("good") & (F.col("first") == 0)).alias("gapless"),
        ((F.min("start") == 0) & (F.sum("length") == F.max(F.col("start") + F.col("length"))) & (F.max("piece") == F.count("*") - 1) & (F.count_if((F.col("length") < 1024) & (F.col("piece") > 0)) == 0)).alias("whole"),
    )


_SHARD_LAW_SQL = "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 16 AS size, 'bytes' AS law, TRUE AS known, TRUE AS near, TRUE AS gapless FROM documents"
_PACKING_LAW_SQL = "SELECT DISTINCT doc_id, TRUE AS gapless, TRUE AS whole FROM documents"
_LM_BASE_SQL = f"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
h(doc_id, s, p, x) AS (SELECT doc_id, doc_id::VARCHAR, 1, 4294967295 FROM documents UNION ALL SELECT doc_id, s, p + 1, xor(x >> 8, t[xor(x & 255, ascii(s[p])) + 1]) FROM h, crc WHERE p <= length(s)),
d AS (SELECT d.doc_id, xor(x, 4294967295) % 7 = 2 AS held_out, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents d JOIN h ON d.doc_id = h.doc_id AND h.p > length(h.s)),
c AS (SELECT tok, count(*) AS c FROM (SELECT unnest(w) AS tok FROM d WHERE NOT held_out) GROUP BY 1),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM (SELECT doc_id, held_out, unnest(w) AS tok FROM d) t LEFT JOIN c USING (tok), n GROUP BY 1, 2"""


def _license_sql() -> str:
    found = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM x WHERE w[i : i + {len(p.split()) - 1}] = [{', '.join(repr(q) for q in p.split())}]" for p, label in licenses.BASE_PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d), f AS ({found}),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)"""


LAWS = {"shard_law": shard_law, "lm_base_scores": lm_base_scores, "license_base_places": license_base_places, "packing_law": packing_law}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | LAWS


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": _op1_sql(), "op6_near_duplicates": _OP6_SQL, "op7_exact_topk": _OP7_SQL, "op8_decontamination": _OP8_SQL,
        "shard_law": _SHARD_LAW_SQL, "lm_base_scores": _LM_BASE_SQL, "license_base_places": _license_sql(), "packing_law": _PACKING_LAW_SQL,
    }
