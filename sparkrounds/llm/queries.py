"""The operators bound to the test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.llm import (
    ann,
    conversation_trie,
    exact_dedup,
    line_dedup,
    lm_scoring,
    mixing,
    ngram_join,
    odd_sketch,
    packing,
    spelling,
    suffix_dedup,
    toxicity,
    warc,
)
from sparkrounds.llm.common import UPPER, table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, to the sources' targets."""
    docs = table(spark, sf_dir, "documents")
    mixed, sources = mixing.mix_to_weights(
        docs.select("doc_id", "source", "text"),
        membership=F.array("source"),
        size=word_count(F.col("text")),
        split_last=True,
    )
    targets = spark.createDataFrame(
        [(s.name, s.size, s.target) for s in sources],
        "name string, source_size long, target double",
    )
    return mixed.join(
        targets.hint("broadcast"), F.col("source").eqNullSafe(F.col("name"))
    ).select("doc_id", "source", "size", "source_size", "target", "copies", "part", "taken")


@query("op2_stream_dedup")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every text, by the state of a stream over all documents."""
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


SQL["op2_stream_dedup"] = f"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_pack")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", "text"), tokenizer=tokenizer_path())


@query("op3_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_warc")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder)


@query("op5_learned_partitions")
def learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest neighbours of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op6_line_dedup")
def line_dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_lines(docs)
    return left.select(
        "doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("kept_sha256")
    )


SQL["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i, list_extract(ls, i) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)
),
solid AS (SELECT * FROM l WHERE regexp_matches(line, '[^\s]')),
firsts AS (
  SELECT line, min((doc_id, i)) AS first, length(line) AS n FROM solid GROUP BY line
),
long AS (SELECT *, unnest(list_distinct([(n - 1) // 2, n // 2])) AS m FROM firsts WHERE n >= 20),
halves AS (
  SELECT *, 'a' AS side, left(line, m) AS half FROM long UNION ALL
  SELECT *, 'z' AS side, right(line, m) AS half FROM long
),
pairs AS (
  SELECT DISTINCT s.line AS s, t.line AS t FROM halves s JOIN halves t
  ON s.side = t.side AND s.m = t.m AND s.half = t.half AND t.first < s.first AND abs(s.n - t.n) <= 1
),
near AS (
  SELECT DISTINCT s AS line FROM pairs WHERE len(list_filter(range(1, greatest(length(s), length(t)) + 1), lambda i:
    left(s, i - 1) = left(t, i - 1) AND CASE
      WHEN length(s) = length(t) THEN substr(s, i + 1) = substr(t, i + 1)
      WHEN length(s) > length(t) THEN substr(s, i + 1) = substr(t, i)
      ELSE substr(s, i) = substr(t, i + 1) END)) > 0
),
judged AS (
  SELECT l.doc_id, l.i, l.line, near.line IS NOT NULL AS near,
         near.line IS NULL AND f.first IS NOT NULL AND (l.doc_id, l.i) <> f.first AS exact
  FROM l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near ON l.line = near.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE near) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT exact AND NOT near), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op10_ngram_join")
def ngram_join_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar five-word shingle sets."""
    docs = table(spark, sf_dir, "documents")
    return ngram_join.jaccard_components(docs.select("doc_id", "text"))


@query("op8_suffix_dedup")
def suffix_dedup_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).drop("kept")


@query("op7_context_mixing")
def context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a mixture of context models."""
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score_texts(docs.select("doc_id", "text"))


@query("op11_conversation_trie")
def conversation_trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with its weights."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def sql_crc32(data: str) -> str:
    """CRC-32 of a list of bytes, bit by bit (polynomial 0xEDB88320 = 3988292384)."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, o: list_reduce(
      [xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))),
      4294967295::BIGINT)"""


SQL["op11_conversation_trie"] = rf"""
WITH own AS MATERIALIZED (
  SELECT conv_id, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS o
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS len,
    {sql_crc32("list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)")} % 4 AS h
  FROM own GROUP BY conv_id
),
plan AS MATERIALIZED (
  SELECT a.*, least(a.h, coalesce(b.len, 0)) AS k FROM ids a LEFT JOIN ids b ON a.base = b.conv_id
),
turns AS (
  SELECT p.conv_id, o.o AS pos, digest, words FROM plan p JOIN own o ON o.conv_id = p.base WHERE o.o <= p.k
  UNION ALL
  SELECT p.conv_id, o.o - p.h + p.k, digest, words FROM plan p JOIN own o ON o.conv_id = p.conv_id WHERE o.o > p.h
),
whole AS MATERIALIZED (
  SELECT p.conv_id, coalesce(list(digest ORDER BY pos) FILTER (WHERE digest IS NOT NULL), []) AS ds,
    coalesce(list(words ORDER BY pos) FILTER (WHERE digest IS NOT NULL), []) AS ws
  FROM plan p LEFT JOIN turns t ON t.conv_id = p.conv_id GROUP BY p.conv_id
),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, sha256(concat(d, ':', array_to_string(ds[:d], ','))) AS key,
    sha256(concat(d - 1, ':', array_to_string(ds[:d - 1], ','))) AS up,
    CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS words, d = len(ds) AS ends
  FROM whole, unnest(range(0, len(ds) + 1)) AS u(d)
),
nodes AS MATERIALIZED (
  SELECT key, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key
),
-- A node lies below every prefix of its smallest member.
subtrees AS (
  SELECT p.key, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens,
    count(*) FILTER (WHERE n.key NOT IN (SELECT up FROM nodes WHERE depth > 0)) AS n_leaves
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.key
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs,
  (SELECT count(*) FROM nodes c WHERE c.up = n.key AND c.depth > 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.key = n.key LEFT JOIN nodes u ON u.key = n.up AND n.depth > 0
"""


@query("op12_spelling_variants")
def spelling_variant_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent spelling that each is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op12_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
),
hashed AS MATERIALIZED (
  SELECT run, c, {sql_crc32("list_transform(range(1, (length(code) // 2) + 1), lambda i: ('0x' || substr(code, 2 * i - 1, 2))::BIGINT)")} AS h
  FROM (SELECT run, count(*) AS c, hex(encode(concat(doc_id, ':', run))) AS code FROM runs GROUP BY doc_id, run)
),
words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
),
holes AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)
),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM near GROUP BY word
),
judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form,
    CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
),
chain AS (
  SELECT word, word AS root, form AS next FROM judged
  UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON c.next = j.word
)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON c.word = j.word AND c.next IS NULL
"""


@query("op13_odd_sketch")
def odd_sketch_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar two-word shingle sets."""
    return odd_sketch.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op13_odd_sketch"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs
),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS t FROM sets),
shared AS (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
linking AS MATERIALIZED (SELECT doc_id, n, t FROM tokens SEMI JOIN shared USING (t)),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM linking a JOIN linking b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT u, b FROM reach JOIN sides ON v = a),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON u = doc_id
"""
