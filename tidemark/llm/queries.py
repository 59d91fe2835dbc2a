"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, filter_audit, lines, mixing, search, sharding, shingles, token_counts, token_records, toxicity, vectors, warc, whitening
from tidemark.llm.common import WORD, table
from tidemark.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The tokenizer file of op5 and op9.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, total, CASE (k - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2.0::DOUBLE * total AS cap FROM s),
o AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(total) FROM s) - coalesce(sum(cap) OVER p, 0) AS rest,
    (SELECT sum(w) FROM w) - coalesce(sum(w) OVER p, 0) AS open
  FROM w WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, total, CASE WHEN cap * open <= w * rest THEN cap
    ELSE w * (SELECT min_by(rest / open, cap / w) FROM o WHERE cap * open > w * rest) END AS target FROM o),
c AS (
  SELECT d.doc_id, d.source, d.size, d.h, t.total, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, least(total, target) AS b1, greatest(0, target - total) AS b2 FROM c)
SELECT doc_id, size, total AS source_size, target,
  (CASE WHEN upto <= b1 OR (upto - same <= b1 AND upto - b1 < b1 - (upto - same)) THEN 1 ELSE 0 END
   + CASE WHEN upto <= b2 OR (upto - same <= b2 AND upto - b2 < b2 - (upto - same)) THEN 1 ELSE 0 END) AS copies,
  size * (CASE WHEN upto <= b1 OR (upto - same <= b1 AND upto - b1 < b1 - (upto - same)) THEN 1 ELSE 0 END
   + CASE WHEN upto <= b2 OR (upto - same <= b2 AND upto - b2 < b2 - (upto - same)) THEN 1 ELSE 0 END) AS taken
FROM b""")
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), weights=[3, 1, 2])


@query("op8_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.keeper IS NOT NULL AND f.keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.keeper IS NULL OR f.keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    done = lines.apply_bitmaps(documents, lines.keep_bitmaps(documents))
    return done.select("doc_id", F.col("_ln_lines").alias("n_lines"), F.col("_ln_dropped").alias("n_dropped"),
                       F.sha2("_ln_kept", 256).alias("kept_sha256"))


@query("op5_bpe")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return encoded_documents(table(spark, folder, "documents"))


def encoded_documents(documents: DataFrame) -> DataFrame:
    """Number and digest of the ids of each document, and digest of the text decoded from them."""
    done = bpe.round_trip(documents, TOKENIZER)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(documents, table(spark, folder, "labels"))
    done = toxicity.score(documents, model)
    return done.select("doc_id", F.col("_tox_severity").alias("severity"), F.col("_tox_grade").alias("grade"), (F.col("_tox_grade") > 0).alias("toxic"))


@query("op10_ngram_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN s USING (doc_id) JOIN m USING (doc_id)""")
def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingles.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id WHERE r.c < l.y),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.x = m.vec_id""")
def embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op1_hamming_top_k", """
WITH c AS (
  SELECT vec_id AS id, list_sum([CASE WHEN embedding[b]::DOUBLE + embedding[b + 32]::DOUBLE >= 0 THEN (1::BIGINT << (b - 1)) ELSE 0 END FOR b IN range(1, 33)])::BIGINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
d AS (
  SELECT q.id AS query_id, c.id, bit_count(xor(q.code, c.code))::BIGINT AS distance,
    row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.code, c.code)), c.id)::INTEGER AS rank
  FROM c q JOIN c ON q.id % 50 = 0 AND c.id <> q.id)
SELECT query_id, rank, id AS vec_id, distance FROM d WHERE rank <= 10""")
def hamming_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vecs = table(spark, folder, "embeddings")
    codes = vecs.select(F.col("vec_id").alias("id"), search.sign_codes(F.col("embedding"), 32).alias("code"))
    # the stated query set: every id divisible by 50
    found = search.top_k(codes, codes.where("id % 50 = 0"), k=10, bits=32)
    return found.withColumnRenamed("id", "vec_id")


@query("op4_warc", """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LETTERS = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"
REVISED = r"[^\x20\x09-\x0D]*[A-Za-z0-9][^\x20\x09-\x0D]*"


@query("op6_token_counts", rf"""
WITH d AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
c AS (
  SELECT source, lang, 'letters' AS version, coalesce(len(regexp_extract_all(text, '{LETTERS}')), 0) AS n FROM d
  UNION ALL SELECT source, lang, 'words', coalesce(len(regexp_extract_all(text, '{REVISED}')), 0) FROM d)
SELECT source, lang, version, count(*) AS docs, sum(n)::BIGINT AS tokens FROM c GROUP BY source, lang, version""")
def token_counts_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents come in two tokenizer versions, one of which is counted anew; toxic ones go; every batch comes twice."""
    documents = table(spark, folder, "documents")

    def counted(op: str, *versions: tuple[str, str]) -> DataFrame:
        counts = F.array(*[F.struct(F.lit(v).alias("version"), F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias("tokens")) for v, p in versions])
        return documents.select(F.lit(op).alias("op"), F.lit(0).alias("seq"), "doc_id", "source", "lang", F.inline(counts))

    gone = table(spark, folder, "labels").where("toxic = 1 and doc_id is not null").select("doc_id").distinct().select(
        F.lit("delete").alias("op"), F.lit(0).alias("seq"), "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.explode(F.array(F.lit("words"), F.lit("letters"))).alias("version"), F.lit(0).cast("long").alias("tokens"))
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"))
    batches = {"load": counted("insert", ("words", WORD), ("letters", LETTERS)), "recount": counted("revise", ("words", REVISED)), "remove": gone}
    for _ in range(2):
        for name, changes in batches.items():
            rollup.apply(name, changes)
    return rollup.totals()


@query("op9_token_records")
def token_record_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "records")
    token_records.write_records(table(spark, folder, "documents"), path, TOKENIZER)
    return token_records.read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.components(table(spark, folder, "embeddings"), k=4)


def _shard_sql(shards: int, seed: int) -> str:
    """The permutation of all row numbers, column by column, then walks until they end inside."""
    ctes = ["s AS (SELECT *, greatest(ceil(n / a), 1)::BIGINT AS b FROM (SELECT n, greatest(ceil(sqrt(n)), 1)::BIGINT AS a FROM (SELECT count(*) AS n FROM documents)))",
            "f0 AS (SELECT z, n, a, b, z // b AS l, z % b AS r FROM s, range(a * b) t(z))"]
    p = sharding.PRIME
    for k, (x, y, c) in enumerate(sharding.round_keys(seed)):
        f = f"SELECT *, (r * {x} + {y}) % {p} AS f FROM f{k}"
        for add in (c, x):
            f = f"SELECT * REPLACE ((f * f + {add}) % {p} AS f) FROM ({f})"
        ctes.append(f"f{k + 1} AS (SELECT z, n, a, b, r AS l, (l + f) % {'b' if k % 2 else 'a'} AS r FROM ({f}))")
    ctes.append(f"p AS (SELECT z, n, l * b + r AS y FROM f{sharding.ROUNDS})")
    ctes.append("w(z, x) AS (SELECT z, y FROM p WHERE z < n UNION ALL SELECT w.z, p.y FROM w JOIN p ON p.z = w.x AND w.x >= p.n)")
    ctes.append("places AS (SELECT w.z, w.x FROM w, s WHERE w.x < s.n)")
    # a crc32 byte by byte, over the table of the reversed polynomial
    ctes.append("crc_table AS (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) x(i))")
    ctes.append("texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents)")
    ctes.append("crcs AS (SELECT text, list_reduce(list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(text), 2 * i + 1, 2))::BIGINT), "
                "lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT) AS c FROM texts, crc_table)")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT d.doc_id, (strlen(coalesce(d.text, '')) + 1)::BIGINT AS size, xor(c, 4294967295)::BIGINT AS text_crc32, 'rows' AS law,
  (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM (SELECT *, row_number() OVER () - 1 AS z FROM documents) d JOIN places USING (z) JOIN crcs ON crcs.text = coalesce(d.text, '')"""


@query("op12_feistel_shards", _shard_sql(sharding.SHARDS, sharding.SEED))
def feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows, n = sharding.numbered(table(spark, folder, "documents"))
    body = F.coalesce("text", F.lit(""))
    return sharding.shard(rows, n).select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_sh_shard").alias("shard"), F.col("_sh_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op13_filter_audit", r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT text, min(doc_id) AS low FROM w GROUP BY text),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    (len(words) < 100)::INT, (100 * len(list_distinct(words)) < 80 * len(words))::INT,
    (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::INT, regexp_matches(text, '[#$%&*|]')::INT, coalesce(doc_id > low, false)::INT] AS fails
  FROM w JOIN x USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
t AS (SELECT o, s.f AS step, o[s.f] AS f, o[1:s.f - 1] AS before FROM o, k s),
m AS (
  SELECT part, o, step, f, n, good, toxic, fails[f] = 1 AS failing, len(list_filter(before, lambda b: fails[b] = 1)) = 0 AS here, list_sum(fails) = 1 AS alone FROM t, c),
r AS (
  SELECT part, o, step, f, sum(n) FILTER (here AND NOT failing) AS kept, sum(n) FILTER (here AND failing) AS removed,
    sum(n) FILTER (failing AND NOT here) AS redundant, sum(n) FILTER (failing AND alone) AS unique_fails,
    sum(good) FILTER (here AND failing) AS good_lost, sum(toxic) FILTER (here AND failing) AS toxic_lost FROM m GROUP BY part, o, step, f)
SELECT part, list_aggregate(list_transform(o, lambda i: chr((64 + i)::INT)), 'string_agg', '') AS filter_order, step::INT AS step,
  coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM r""")
def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
