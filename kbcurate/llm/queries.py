"""The registered queries of the numbered operators, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbcurate.llm import (
    ann, counts, lexical, licences, minhash, mixing, packing, quality, substring, suffixes, tokenfile, trie, vectors,
)
from kbcurate.llm.store import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return wrap


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; the same place on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(oracle=r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)
), firsts AS (
  SELECT k, min(doc_id) AS f FROM win GROUP BY k
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN firsts USING (k) WHERE f < doc_id)
  GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string(list_select(ws, list_sort(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)))), ' ') END AS t
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM kept
""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed",
        substring.kept_sha256(F.col("kept_text")).alias("kept_sha256"),
    )


@query()
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(oracle=r"""
WITH base AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), drawn AS (
  SELECT *, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_key) AS draw FROM base
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) AS position
  FROM drawn GROUP BY source
), weighed AS (
  SELECT *, (position - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM named
), levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev
  FROM weighed
  WINDOW w AS (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
  SELECT *, CASE WHEN ratio > fin THEN fin * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM (SELECT *, max(CASE WHEN ratio > lev THEN lev END) OVER () AS fin FROM levels)
), blocked AS (
  SELECT *, CAST(ceil(greatest(source_size / 1000000, n / 20000)) AS BIGINT) AS shards,
    CAST(greatest(1, least(64, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 100))) AS BIGINT) AS block
  FROM aimed
), seated AS (
  SELECT *, CAST(round(sum(source_size) OVER () / block) AS BIGINT) AS seats FROM blocked
), c1 AS (
  SELECT *, target / sum(target) OVER () AS share, count(*) OVER () AS m FROM seated WHERE target > 0
), c2 AS (
  SELECT *, CAST(greatest(0, floor(share * seats - (share * m / 2 + 1))) AS BIGINT) AS low,
         CAST(ceil(share * seats + share * m / 2 + 1) AS BIGINT) AS high FROM c1
), c3 AS (
  SELECT position, low, k, seats - (SELECT sum(low) FROM c2) AS remain,
         row_number() OVER (ORDER BY target / (2 * k + 1) DESC, position, k) AS r
  FROM (SELECT *, unnest(range(low, high)) AS k FROM c2)
), quota AS (
  SELECT position, any_value(low) + count(*) FILTER (WHERE r <= remain) AS quota FROM c3 GROUP BY position
), placed AS (
  SELECT d.*, s.position, s.source_size, s.target, s.block, coalesce(q.quota, 0) AS source_quota,
         CAST('0x' || substr(draw, 1, 8) AS BIGINT) % s.shards AS shard
  FROM drawn d JOIN seated s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN quota q USING (position)
), sh AS (
  SELECT position, shard, any_value(block) AS block, any_value(source_quota) AS seats, CAST(sum(size) AS BIGINT) AS shard_size
  FROM placed GROUP BY position, shard HAVING sum(size) > 0
), s1 AS (
  SELECT *, CAST(greatest(1, round(shard_size / block)) AS BIGINT) AS blocks,
         shard_size / sum(shard_size) OVER (PARTITION BY position) AS share, count(*) OVER (PARTITION BY position) AS m FROM sh
), s2 AS (
  SELECT *, CAST(least(greatest(0, floor(share * seats - (share * m / 2 + 1))), 3 * blocks) AS BIGINT) AS low,
         CAST(least(ceil(share * seats + share * m / 2 + 1), 3 * blocks) AS BIGINT) AS high FROM s1
), s3 AS (
  SELECT *, seats - sum(low) OVER (PARTITION BY position) AS remain FROM s2
), s4 AS (
  SELECT position, shard, k, remain,
         row_number() OVER (PARTITION BY position ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS r
  FROM (SELECT *, unnest(range(low, high)) AS k FROM s3)
), won AS (
  SELECT position, shard, count(*) FILTER (WHERE r <= remain) AS more FROM s4 GROUP BY position, shard
), shard_quota AS (
  SELECT position, shard, shard_size, blocks, low + coalesce(more, 0) AS quota FROM s3 LEFT JOIN won USING (position, shard)
), ended AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY position, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM placed
)
SELECT doc_id, size, source_size, target,
       CAST(coalesce((quota // blocks) * size
         + greatest(0, least(e, CAST(floor((quota % blocks) * shard_size / blocks) AS BIGINT)) - (e - size)), 0) AS BIGINT) AS taken
FROM ended LEFT JOIN shard_quota USING (position, shard)
""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    folder = f"{scratch.base}/files"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        spark._jsc.hadoopConfiguration()
    ).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    docs = table(spark, sf_dir, "documents")
    files = scratch.write(tokenfile.write_tokens(docs, folder, vocabulary("word_bpe_49k.json")))
    out = tokenfile.read_tokens(spark, folder, files)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


@query()
def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


@query()
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0))


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    out = quality.classify(table(spark, sf_dir, "documents"), trusted.select(F.col("doc_id").alias("id")))
    return out.withColumnRenamed("id", "doc_id")


def _licence_sql() -> str:
    """SQL over the same template values."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ",\n  ".join(
        f"({at}, {text(name)}, [{', '.join(map(text, grams))}], {low}, {high})"
        for at, name, grams, low, high in licences.template_rows()
    )
    return rf"""
WITH t(pos, licence, grams, low, high) AS (VALUES
  {rows}
), clean AS (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS c FROM documents
), seg AS (
  SELECT doc_id, unnest(list_concat(string_split(c, chr(10)),
    CASE WHEN contains(c, chr(10)) THEN [regexp_replace(c, '[ \n]+', ' ', 'g')] ELSE [] END)) AS s FROM clean
), sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT doc_id, string_split(trim(s), ' ') AS w FROM seg)
), scored AS (
  SELECT doc_id, s, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS score, pos, licence
  FROM (SELECT *, row_number() OVER () AS s FROM sets) JOIN t ON len(g) BETWEEN low AND high
), best AS (
  SELECT doc_id, s, max(score) AS score, arg_min(licence, (-score, pos)) AS licence, min((-score, pos)) AS k
  FROM scored GROUP BY doc_id, s HAVING max(score) >= {licences.THRESHOLD}
), top AS (
  SELECT doc_id, arg_min(licence, k) AS licence, max(score) AS score, count(*) AS n_segments FROM best GROUP BY doc_id
)
SELECT doc_id, licence, coalesce(score, 0.0::DOUBLE) AS score, CAST(coalesce(n_segments, 0) AS BIGINT) AS n_segments
FROM documents LEFT JOIN top USING (doc_id)
"""


@query(oracle=_licence_sql())
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(oracle=r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda z: CAST(0 AS UBIGINT))),
      lambda a, z: CASE WHEN a % 2 = 1 THEN xor(CAST(3988292384 AS UBIGINT), a >> 1) ELSE a >> 1 END) AS v
    FROM range(256) r(i))
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(k)) AS pos, md5(k) AS k, width FROM (
    SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS k,
           length(coalesce(text, '')) AS width
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, xor(CAST(4294967295 AS UBIGINT), list_reduce(
      list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1]))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), tab
), said AS (
  SELECT c.conv_id, t.pos, t.k, t.width, 0 AS own FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.k, t.width, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
  SELECT conv_id, coalesce(list(k ORDER BY own, pos) FILTER (WHERE k IS NOT NULL), []) AS p,
         coalesce(list(width ORDER BY own, pos) FILTER (WHERE k IS NOT NULL), []) AS ws
  FROM convs LEFT JOIN said USING (conv_id) GROUP BY conv_id
), steps AS (
  SELECT conv_id, d, md5(array_to_string(list_slice(p, 1, d), '')) AS node, len(p) = d AS ends,
         CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS width,
         CASE WHEN d = 0 THEN NULL ELSE md5(array_to_string(list_slice(p, 1, d - 1), '')) END AS up
  FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, d AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(width) AS width,
         string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS e
  FROM steps GROUP BY node, d
), kids AS (SELECT up AS node, count(*) AS c FROM nodes WHERE up IS NOT NULL GROUP BY up
), tree AS (
  SELECT n.*, coalesce(c, 0) AS c FROM nodes n LEFT JOIN kids USING (node)
), anc AS (
  SELECT DISTINCT a.node AS top, b.node FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.d <= b.d
), sums AS (
  SELECT top, sum(CASE WHEN t.c = 0 THEN 1 ELSE 0 END) AS leaves, sum((t.n - 1) * t.width) AS saved
  FROM anc JOIN tree t ON t.node = anc.node GROUP BY top
)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, t.n AS n_convs, t.c AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(t.e, '')) AS ends_sha256
FROM tree t JOIN sums ON sums.top = t.node LEFT JOIN tree u ON u.node = t.up
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query(oracle=r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), post AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, corpus GROUP BY term, nn
), gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))) AS gain
  FROM post JOIN weights USING (term), corpus
), scored AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN gains USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
