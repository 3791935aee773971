"""The registered corpus queries with their SQL twins, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagerisk.llm import (
    bpe, langid, lines, main_text, minhash, mixing, packing, quality, repetition, resample,
    substrings, trie, vectors,
)
from pagerisk.session import attach

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(attach(spark), sf_dir)

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS queue
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(rank % 3 + 1)::INT] AS weight, source_size * 2 AS cap,
    sum(source_size) OVER () * 150 / 100.0::DOUBLE AS budget
  FROM named),
levelled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
settled AS (
  SELECT level FROM levelled WHERE level * weight <= cap
  ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
targets AS (
  SELECT source, rank, source_size, budget,
    coalesce(least(cap::DOUBLE, (SELECT level FROM settled) * weight), cap::DOUBLE) AS target
  FROM levelled),
queued AS (
  SELECT row_number() OVER () AS n, d.*, t.rank, t.source_size, t.target, t.budget,
    sum(size) OVER (PARTITION BY t.rank ORDER BY queue ROWS UNBOUNDED PRECEDING) AS ending
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
entries AS (
  SELECT n, size, budget, rank, queue, pass, CASE WHEN target > 0
    THEN (ending + pass * source_size)::DOUBLE / target ELSE 0.0::DOUBLE END AS finish
  FROM queued, (VALUES (0), (1)) p(pass)),
totals AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, queue, pass ROWS UNBOUNDED PRECEDING) AS total
  FROM entries),
taken AS (SELECT n, sum(size) FILTER (WHERE total <= budget) AS taken FROM totals GROUP BY n)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size::BIGINT AS source_size, q.target,
  coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q JOIN taken t USING (n)
"""


@query(MIX_SQL)
def op8_fair_mix(spark, sf_dir):
    """Words taken from every document when all sources are mixed to their targets."""
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_byte_bpe(spark, sf_dir):
    """Tokens and round trip of every document under the byte-level tokenizer."""
    return bpe.encode_decode(
        documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.json"),
        ("n_tokens", "ids_sha256", "decoded_sha256"),
        keep=["doc_id"],
    )


@query()
def op10_packed_ids(spark, sf_dir):
    """Every document's place, length and checksum in the packed files, read back from them."""
    return packing.pack_documents(
        documents(spark, sf_dir),
        public_tokenizers.path("word_bpe_49k.json"),
        fields=("ids_crc32",),
    )


REPEATS_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts),
fives AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM starts),
five AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS place FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM fives) WHERE times > 1)
  GROUP BY doc_id),
twenties AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS gram FROM starts WHERE i + 19 <= len(w)),
repeated AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM twenties)
  WHERE times > 1),
twenty AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 20)) AS place FROM repeated) GROUP BY doc_id),
runs AS (
  SELECT doc_id, shift, i - row_number() OVER (PARTITION BY doc_id, shift ORDER BY i) AS run
  FROM (SELECT a.doc_id, a.i, b.i - a.i AS shift FROM repeated a
        JOIN repeated b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i)),
longest AS (
  SELECT doc_id, max(n) + 19 AS n
  FROM (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id, shift, run) GROUP BY doc_id),
full_lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
measured AS (
  SELECT doc_id, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(five.n, 0) AS n_repeat_words, coalesce(twenty.n, 0) AS n_covered_words,
    coalesce(longest.n, 0) AS longest_repeat
  FROM texts JOIN full_lines USING (doc_id) LEFT JOIN five USING (doc_id)
  LEFT JOIN twenty USING (doc_id) LEFT JOIN longest USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND 100 * n_covered_words <= 10 * n_words AND longest_repeat <= 50 AS kept
FROM judged
"""


@query(REPEATS_SQL)
def op4_repetition(spark, sf_dir):
    """Repetition measures and verdict of every document."""
    return repetition.judge(documents(spark, sf_dir), keep=["doc_id"])


SHINGLES_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a
  JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


@query(SHINGLES_SQL)
def op7_near_duplicates(spark, sf_dir):
    """Groups of documents that share four in five of their two-word shingles."""
    return minhash.near_duplicates(documents(spark, sf_dir), width=2)


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.n AS a, b.n AS b, b.vec_id FROM good a JOIN good b ON a.label = b.label AND a.n <> b.n
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT n AS a, n AS b, vec_id FROM v
  UNION
  SELECT r.a, l.b, l.vec_id FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = n) AS n_links, component_id,
  coalesce(vec_id = component_id, true) AS kept
FROM v JOIN least ON a = n
"""


@query(VECTOR_SQL)
def op1_near_vectors(spark, sf_dir):
    """Links and groups of embeddings of equal label and nearly equal direction."""
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


LINES_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
words AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t
  FROM cut),
lines AS (
  SELECT doc_id, i, t, words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n
  FROM words WHERE words > 0),
spans AS (
  SELECT a.doc_id, a.n, b.n AS e, string_agg(c.t, chr(10) ORDER BY c.n) AS body
  FROM lines a
  JOIN lines b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + 9
  JOIN lines c ON a.doc_id = c.doc_id AND c.n BETWEEN a.n AND b.n
  GROUP BY ALL HAVING sum(c.words) >= 10),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, n) AS copy FROM spans),
gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM ranked r
  JOIN lines l ON l.doc_id = r.doc_id AND l.n BETWEEN r.n AND r.e WHERE copy > 1),
kept AS (
  SELECT w.doc_id, count(*) FILTER (WHERE w.words > 0) AS n_lines, count(g.i) AS n_deleted,
    string_agg(w.line, chr(10) ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS text
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@query(LINES_SQL)
def op5_line_runs(spark, sf_dir):
    """Every document without the line runs that an earlier place holds already."""
    out = lines.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_deleted", "text")


# The blocks of the only article of a page, as the page table writes them.
ARTICLE_SQL = r"""
WITH articles AS (
  SELECT page_id, url, string_split_regex(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1),
    '</?(?:p|h1)>') AS parts
  FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(
    replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)),
    '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
  FROM articles),
texts AS (
  SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''),
    chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""


@query(ARTICLE_SQL)
def op3_main_text(spark, sf_dir):
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text.extract(pages, keep=["page_id", "url"])


@query()
def op6_languages(spark, sf_dir):
    """Predicted language of every document."""
    return langid.identify(documents(spark, sf_dir))


@query()
def op2_quality(spark, sf_dir):
    """Quality score and verdict of every document."""
    return quality.classify(documents(spark, sf_dir))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of an expression."""
    parts, value = [], 0xEDB88320
    for bit in range(7, -1, -1):  # what each bit of a byte adds to the state
        parts.append(f"((x >> {bit}) & 1) * {value}")
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    table = parts[0]
    for part in parts[1:]:
        table = f"xor({table}, {part})"
    octets = (
        f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: "
        f"('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)"
    )
    fold = table.replace("x >>", "(xor(c, b) & 255) >>")
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: "
        f"xor(c >> 8, {fold})), 4294967295)"
    )


RESAMPLE_SQL = rf"""
WITH texts AS (
  SELECT 0 AS side, doc_id, text FROM documents
  UNION ALL SELECT 1, item_id, text FROM benchmark),
cut AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM cut, (VALUES (1), (2), (3)) s(n)),
features AS (
  SELECT side, doc_id, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS times
  FROM runs GROUP BY ALL),
marked AS (
  SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features)),
placed AS (SELECT side, doc_id, bucket, times FROM features JOIN marked USING (f)),
counts AS (
  SELECT b AS bucket, coalesce(sum(times) FILTER (WHERE side = 0), 0)::DOUBLE AS s,
    coalesce(sum(times) FILTER (WHERE side = 1), 0)::DOUBLE AS t
  FROM range(10000) r(b) LEFT JOIN placed ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000)
    / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
  FROM counts),
weights AS (
  SELECT doc_id, sum(times * gain)::BIGINT AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT c.doc_id, len(w) AS n_words,
    (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features,
    coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('42:' || c.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT
      AS score
  FROM cut c LEFT JOIN weights USING (doc_id) WHERE side = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
    count(*) OVER () * 5 // 100 AS drawn
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, rank
FROM scored LEFT JOIN (SELECT doc_id, rank FROM ranked WHERE rank <= drawn) USING (doc_id)
"""


@query(RESAMPLE_SQL)
def op11_importance_resampling(spark, sf_dir):
    """Features, weight, score and rank of every document against the benchmark texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = resample.resample(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


TRIE_SQL = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS n,
    [coalesce(role, ''), coalesce(text, '')] AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list(t ORDER BY n) AS ts FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.c, coalesce(b.ts, [])[:h] || o.ts[h + 1:] AS ts
  FROM (SELECT *, {crc32_sql("c::VARCHAR")} % 4 AS h FROM own) o
  LEFT JOIN own b ON b.c = o.c - o.c % 20),
prefixes AS (SELECT c, d, ts[:d] AS p, d = len(ts) AS ends
  FROM rebuilt, LATERAL (SELECT unnest(range(len(ts) + 1)) AS d)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d > 0
      THEN len(regexp_extract_all(p[d][2], '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM prefixes GROUP BY p, d),
named AS (SELECT row_number() OVER () AS k, * FROM nodes),
children AS (
  SELECT b.k, count(*) AS n FROM named a JOIN named b ON b.d = a.d - 1 AND b.p = a.p[:a.d - 1]
  GROUP BY b.k),
below AS (
  SELECT a.k, sum(b.saved) AS saved, count(*) FILTER (WHERE coalesce(c.n, 0) = 0) AS leaves
  FROM named a JOIN named b ON b.d >= a.d AND b.p[:a.d] = a.p
  LEFT JOIN children c ON c.k = b.k GROUP BY a.k)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs,
  coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens,
  x.ends_sha256
FROM named x JOIN below b USING (k) LEFT JOIN children c USING (k)
LEFT JOIN named p ON p.d = x.d - 1 AND p.p = x.p[:x.d - 1]
"""


@query(TRIE_SQL)
def op12_conversation_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


WINDOWS_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT n, i, array_to_string(w[i:i + 34], ' ') AS body
  FROM (SELECT n, w, unnest(range(1, len(w) - 33)) AS i FROM texts)),
repeated AS (
  SELECT n, i FROM windows
  WHERE body IN (SELECT body FROM windows GROUP BY body HAVING count(*) > 1)),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 35)) AS place FROM repeated),
lists AS (SELECT n, list(place) AS gone FROM gone GROUP BY n),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_transform(
      list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])),
      lambda x: x[1]) END AS left_over
  FROM texts LEFT JOIN lists USING (n))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""


@query(WINDOWS_SQL)
def op13_repeated_windows(spark, sf_dir):
    """Words of every document that stay when windows that occur twice are removed."""
    out = substrings.remove_repeats(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
