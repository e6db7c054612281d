"""The subpackage's queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.sharding import shard_by_bytes

    return shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents, decoded again: counts, digests and whether nothing was lost."""
    import public_tokenizers

    from scriptorium.llm.piece_sampling import encode_and_decode

    rows = encode_and_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == text).alias("lossless"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated URL list made from the pages' own hosts by rule: the public tables have none.

    A host's md5 decides whether it is blocked or allowed, as host or as domain, from which day, and
    whether the entry was removed later; one page in 16 has a dated entry of its first path segments.
    """
    from scriptorium.llm.url_filter import host_of

    seen = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", PREFIX, 1).alias("prefix")).where("host <> ''")
    rule = lambda name: F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long")
    h = rule("pattern")
    hosts = seen.select(F.col("host").alias("pattern"), F.when(rule("host") % 2 == 0, "host").otherwise("domain").alias("kind")).distinct().where(h % 4 != 3)
    paths = seen.where("prefix <> ''").select(F.col("prefix").alias("pattern"), F.lit("prefix").alias("kind")).distinct().where(h % 16 == 5)
    base = hosts.unionByName(paths).select(
        "kind", "pattern", F.when(h % 5 == 0, "allow").otherwise("block").alias("verdict"),
        F.concat(F.lit("c"), (h % 7).cast("string")).alias("category"), F.date_add(F.lit("2024-01-01").cast("date"), (h % 300).cast("int")).alias("day"),
    )
    gone = base.where(h % 3 == 0).withColumn("day", F.date_add("day", (20 + h % 60).cast("int")))
    return base.withColumn("action", F.lit("add")).unionByName(gone.withColumn("action", F.lit("remove")))


PREFIX = "//([^/?#]+/[^/?#]+/[0-9]+)"


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, fetched on a day by page_id, against the dated list made from their hosts."""
    from scriptorium.llm.url_filter import judge

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return judge(pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched")), list_entries(pages)).withColumnRenamed("capture_id", "page_id")


ORACLE_OP3 = """
WITH p AS (
  SELECT page_id, CAST('2024-01-01' AS DATE) + CAST(page_id % 366 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segments,
         regexp_extract(url, '//([^/?#]+/[^/?#]+/[0-9]+)', 1) AS prefix
  FROM pages
), names AS (
  SELECT DISTINCT host AS pattern, CASE WHEN CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) % 2 = 0 THEN 'host' ELSE 'domain' END AS kind FROM p WHERE host <> '' AND CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) % 4 <> 3
  UNION ALL
  SELECT DISTINCT prefix, 'prefix' FROM p WHERE prefix <> '' AND CAST('0x' || substr(md5(prefix), 1, 7) AS BIGINT) % 16 = 5
), base AS (
  SELECT kind, pattern, CASE WHEN CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) % 5 = 0 THEN 'allow' ELSE 'block' END AS verdict, 'c' || (CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) % 7) AS category,
         CAST('2024-01-01' AS DATE) + CAST(CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) % 300 AS INTEGER) AS since,
         CASE WHEN CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) % 3 = 0 THEN CAST('2024-01-01' AS DATE) + CAST(CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) % 300 + 20 + CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) % 60 AS INTEGER) END AS until,
         CASE kind WHEN 'host' THEN 'h:' WHEN 'domain' THEN 'd:' ELSE 'p:' END || pattern AS key
  FROM names
), asked AS (
  SELECT page_id, fetched, 'h:' || host AS key, 1000 AS rank FROM p
  UNION ALL
  SELECT page_id, fetched, 'd:' || array_to_string(string_split(host, '.')[-k:], '.'), k FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p)
  UNION ALL
  SELECT page_id, fetched, 'p:' || host || '/' || array_to_string(segments[1:k], '/'), 1000 + k FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS k FROM p)
), hit AS (
  SELECT page_id, base.*, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, since DESC, verdict = 'block' DESC, category DESC, base.key DESC) AS n
  FROM asked JOIN base ON asked.key = base.key AND since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT p.page_id, p.host, coalesce(verdict, 'none') AS verdict, key AS entry, category, since AS active_since
FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND n = 1
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "visible", F.char_length("visible").cast("long").alias("n_chars"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scriptorium.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The conversation that holds control strings inside its texts.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.chat import digests, format_conversations

    rows = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).drop("rewritten")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.quality import held_out, score, train

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.jaccard import near_groups

    return near_groups(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.importance import importance_sample

    return importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20)


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.nearest import nearest_vectors

    return nearest_vectors(_table(spark, sf_dir, "embeddings"), top=20, every=20).drop("on_curve")


ORACLE_OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')
), e AS (
  SELECT *, replace(replace(replace(text, '<|esc|>', '<|esc|>esc|>'), '<|im_start|>', '<|esc|>im_start|>'), '<|im_end|>', '<|esc|>im_end|>') AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


#: Whole sets as text, equal ones once; pairs of sets of like size by their shared shingles; what each reaches.
ORACLE_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS tokens FROM d
), k AS (
  SELECT doc_id, len(tokens) AS n, tokens, sha256(array_to_string(list_sort(tokens), chr(10))) AS key FROM s
), c AS (
  SELECT key, n, min(doc_id) AS node, arg_min(tokens, doc_id) AS tokens FROM k WHERE n > 0 GROUP BY key, n
), t AS (
  SELECT node, n, unnest(tokens) AS token FROM c
), l AS (
  SELECT a.node AS x, b.node AS y FROM t a JOIN t b ON a.token = b.token AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT node, node AS reached FROM c UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x
), g AS (
  SELECT node, min(reached) AS label FROM r GROUP BY node
)
SELECT k.doc_id, k.n AS n_shingles, coalesce(g.label, k.doc_id) AS component_id
FROM k LEFT JOIN c ON c.key = k.key AND c.n = k.n LEFT JOIN g ON g.node = c.node
"""


def _coded(book: str) -> str:
    """Each part with the nearest entry of a codebook, by squared distance, then index."""
    far = " + ".join(f"(p.x[{k}] - b.x[{k}]) * (p.x[{k}] - b.x[{k}])" for k in range(1, 5))
    return f"SELECT i, part, min((CAST({far} AS BIGINT), entry)) AS m FROM p JOIN {book} b USING (part) GROUP BY i, part"


def _moved(coded: str, book: str) -> str:
    """A codebook after its entries became the floored means of their parts."""
    mean = ", ".join(f"CAST((sum(p.x[{k}]) - ((sum(p.x[{k}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for k in range(1, 5))
    return f"SELECT part, entry, coalesce(n.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT part, c.m[2] AS entry, [{mean}] AS x FROM {coded} c JOIN p USING (i, part) GROUP BY 1, 2) n USING (part, entry)"


#: Vectors of 64 components, as the table has.
ORACLE_OP11 = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT i, part, c[4 * part + 1 : 4 * part + 4] AS x FROM v, range(16) AS r(part)
), b0 AS (
  SELECT part, i - 1 AS entry, x FROM p WHERE i <= 64
), c1 AS ({_coded("b0")}), b1 AS ({_moved("c1", "b0")}), c2 AS ({_coded("b1")}), b2 AS ({_moved("c2", "b1")}), c3 AS ({_coded("b2")}),
d AS (
  SELECT i, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM c3 GROUP BY i
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM v JOIN d USING (i)
"""

#: Checksums byte by byte over a table made by the rule; every distinct n-gram once.
ORACLE_OP12 = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), texts AS MATERIALIZED (
  SELECT 0 AS src, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS MATERIALIZED (
  SELECT src, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), g AS MATERIALIZED (
  SELECT src, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM w
), h AS MATERIALIZED (
  SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM g)
), b AS MATERIALIZED (
  SELECT gram, CAST(xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT)), lambda c, v: xor(c >> 8, t[CAST(xor(c, v) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 10000 AS BIGINT) AS bucket
  FROM h, crc
), f AS MATERIALIZED (
  SELECT src, id, bucket FROM g JOIN b USING (gram)
), n AS (
  SELECT bucket, count(*) FILTER (WHERE src = 0) AS s, count(*) FILTER (WHERE src = 1) AS t FROM f GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n
), v AS (
  SELECT id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN gain USING (bucket) WHERE src = 0 GROUP BY id
), d AS (
  SELECT doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN v USING (id) WHERE src = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, 5 * count(*) OVER (PARTITION BY eligible) // 100 AS draw FROM d
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= draw THEN place END AS rank FROM r
"""

#: The exact result, components added from the first to the last.
ORACLE_OP13 = """
WITH v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(range(1, 65), lambda k: q.e[k] * x.e[k])) AS score
  FROM v q JOIN v x ON q.i <> x.i AND q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sharding, op2_sentencepiece_sampling, op3_url_filters, op4_best_fit_packing, op5_chat_formatting, op6_exact_dedup,
        op7_html_extraction, op8_quality_classifier, op9_ngram_jaccard_join, op10_document_fingerprints,
        op11_vector_codes, op12_importance_resampling, op13_nearest_vectors,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": ORACLE_OP3, "op5_chat_formatting": ORACLE_OP5, "op6_exact_dedup": ORACLE_OP6, "op9_ngram_jaccard_join": ORACLE_OP9,
        "op11_vector_codes": ORACLE_OP11, "op12_importance_resampling": ORACLE_OP12, "op13_nearest_vectors": ORACLE_OP13,
    }
