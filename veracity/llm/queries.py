"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import MinHashParams, near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"),
                           MinHashParams(shingle=2))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)),
                                      lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
el AS (SELECT doc_id, n, unnest(s) AS e FROM sized),
df AS (SELECT e, count(*) AS c FROM el GROUP BY e),
-- two sets that share 80 % of their union share one of each one's rarest fifth
pre AS (
  SELECT doc_id, n, e FROM (
    SELECT el.doc_id, el.n, el.e, row_number() OVER (
      PARTITION BY el.doc_id ORDER BY df.c, el.e) AS k
    FROM el JOIN df USING (e))
  WHERE k <= n - (4 * n + 4) // 5 + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b
  ON a.e = b.e AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (
    SELECT a, b, x.n + y.n AS total,
           len(list_intersect(x.s, y.s)) AS k
    FROM cand JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b)
  WHERE 100 * k >= 80 * (total - k)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.id),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sized JOIN comp ON id = doc_id
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix
    plan = plan_mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.round("position", 6).alias("position"))
    return plan.repartitionByRange("position", "doc_id")


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(
           text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('13|' || coalesce(doc_id::VARCHAR, '') || '|'
           || coalesce(md5(text), '')), 1, 15))::BIGINT AS k
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                   + 1] AS w
  FROM docs GROUP BY source),
-- sources reach their cap in the order of cap / weight
ordered AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS used,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights,
         150 * sum(source_size) OVER () AS budget
  FROM per WINDOW before AS (
    ORDER BY 2 * source_size / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT budget - 100 * used AS left_, weights FROM ordered
  WHERE w * (budget - 100 * used) < 200 * source_size * weights
  ORDER BY 2 * source_size / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT o.source, o.source_size, CASE
    WHEN l.left_ IS NULL
      OR o.w * l.left_ >= 200 * o.source_size * l.weights
    THEN (2 * o.source_size)::DOUBLE
    ELSE o.w::DOUBLE * l.left_::DOUBLE / (100 * l.weights)::DOUBLE
    END AS target
  FROM ordered o LEFT JOIN level l ON true),
placed AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM docs d),
ranked AS (
  SELECT source, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r
  FROM per),
goals AS (
  SELECT p.doc_id, p.size, p.place, t.source_size, t.target, k.r,
         round(t.target)::BIGINT AS goal, p.place / t.target AS due
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
  JOIN ranked k ON p.source IS NOT DISTINCT FROM k.source),
taken AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0
    ELSE (goal // source_size) * size + least(greatest(
      goal - (goal // source_size) * source_size - place, 0), size)
    END::BIGINT AS taken
  FROM goals)
-- weights 1.5 to 0.5; 0.5 to 1.5 to 0.5; 0.5 to 1.5: the inverse integrals
SELECT doc_id, size, source_size, target, taken, CASE
  WHEN taken = 0 THEN NULL WHEN due >= 1 THEN 1.0::DOUBLE
  WHEN r = 0 THEN round(2 * due / (1.5 + sqrt(2.25 - 2 * due)), 6)
  WHEN r = 2 THEN round(2 * due / (0.5 + sqrt(0.25 + 2 * due)), 6)
  WHEN due < 0.5 THEN round(2 * due / (0.5 + sqrt(0.25 + 4 * due)), 6)
  ELSE round(0.5 + 2 * (due - 0.5) / (1.5 + sqrt(2.25 - 4 * (due - 0.5))), 6)
  END AS position
FROM taken
"""


def op3_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_table
    return shard_table(read_table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages
    return archive_pages(read_table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n,
         sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
      ('0x' || substr(h, (1 + 5 * (k // 4))::INT, 5))::BIGINT
      >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_turns, read_back
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_turns(rows))


OP5_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
shown AS (
  SELECT *, length(role) + length(text)
    + len(regexp_extract_all(role || ' ' || text,
        '␛|<\|begin\|>|<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]'
        || '|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>'
        || '|<\|endoftext\|>'))
    + length('<|turn|><|text|><|end|>') AS chars
  FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn,
                    role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT
    AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                  FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + length('<|begin|>'))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed import link_vectors
    return link_vectors(read_table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e)))
        = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings
  UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c AS component_id,
       e.vec_id = c AS kept
FROM embeddings e JOIN comp ON id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import DecontamParams, contamination
    return contamination(read_table(spark, sf_dir, "documents"),
                         read_table(spark, sf_dir, "benchmark"),
                         DecontamParams(slop=2))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(
    text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(
    text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(
    w[k:k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1))
          AS k FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM dw, sizes WHERE len(w) >= n)),
found AS (
  SELECT g.doc_id, g.k, g.n, x.item_id FROM grams g JOIN windows x
  ON g.n = x.n AND g.win = x.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items,
         string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found)
  GROUP BY doc_id),
-- proximity: 80 % of a window's words at most 2 places from theirs
nwin AS (
  SELECT row_number() OVER () AS wid, item_id, n, string_split(win, ' ') AS x,
         ceil(0.8 * n - 1e-9)::BIGINT AS need FROM windows),
postings AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos
  FROM dw),
common AS (SELECT word, count(*) AS c FROM postings GROUP BY word),
terms AS (
  SELECT wid, k, t.word, row_number() OVER (
    PARTITION BY wid ORDER BY coalesce(c, 0), k) AS rare, n - need + 1 AS few
  FROM (SELECT wid, n, need, unnest(x) AS word,
               unnest(range(1, n + 1)) AS k FROM nwin) t
  LEFT JOIN common ON common.word = t.word),
starts AS (
  SELECT DISTINCT doc_id, wid, pos - k + 1 + unnest(range(-2, 3)) AS p
  FROM terms JOIN postings USING (word) WHERE rare <= few),
near AS (
  SELECT doc_id, item_id, p, n FROM (
    SELECT s.doc_id, v.item_id, s.p, v.n, v.need, list_sum(list_transform(
      range(1, v.n + 1), lambda k: list_contains(
        d.w[greatest(s.p + k - 3, 1):greatest(s.p + k + 1, 0)], v.x[k])::INT))
      AS hits
    FROM starts s JOIN nwin v ON v.wid = s.wid JOIN dw d ON d.doc_id = s.doc_id)
  WHERE hits >= need),
near_items AS (
  SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n FROM near
  GROUP BY doc_id),
near_hit AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT near.doc_id, unnest(range(greatest(p, 1),
      least(p + n, len(d.w) + 1))) AS q
    FROM near JOIN dw d ON d.doc_id = near.doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words,
  coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)
    AS contaminated,
  coalesce(nh.n, 0)::BIGINT AS n_near_hit,
  coalesce(ni.n, 0)::BIGINT AS n_near_items
FROM dw d LEFT JOIN hit h ON h.doc_id = d.doc_id
LEFT JOIN items i ON i.doc_id = d.doc_id
LEFT JOIN near_hit nh ON nh.doc_id = d.doc_id
LEFT JOIN near_items ni ON ni.doc_id = d.doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity
    return toxicity(read_table(spark, sf_dir, "documents"),
                    read_table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_report
    return license_report(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import section_table
    return section_table(read_table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors
    found = cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"),
                             ",").cast("binary"), 256).alias(
            "centroid_sha256"))


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out one after the other."""
    near = """
a{r} AS (
  SELECT vec_id, x, c, d FROM (
    SELECT v.vec_id, v.x, m.c, list_sum(list_transform(range(1, 65),
             lambda i: (v.x[i] - m.y[i]) * (v.x[i] - m.y[i])))::BIGINT AS d
    FROM v CROSS JOIN m{r} m)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    step = """
s{r} AS (
  SELECT c, i, sum(e)::HUGEINT AS s, count(*) AS n
  FROM (SELECT c, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{r})
  GROUP BY c, i),
m{n} AS (
  SELECT c, y FROM m{r} WHERE c NOT IN (SELECT c FROM a{r})
  UNION ALL
  SELECT c, list((CASE WHEN s >= 0 THEN s // n
                  ELSE -((-s + n - 1) // n) END)::BIGINT ORDER BY i)
  FROM s{r} GROUP BY c)"""
    parts = [f"""WITH v AS (
  SELECT vec_id, list_transform(embedding,
           lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e)))
        = 0),
m0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (
    SELECT sha256('2:' || vec_id::VARCHAR) AS h, x FROM v
    ORDER BY h LIMIT {k}))"""]
    for r in range(rounds):
        parts += [near.format(r=r), step.format(r=r, n=r + 1)]
    parts.append(near.format(r=rounds))
    return ",".join(parts) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance,
       (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.y, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m ON a.c = m.c
"""


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias(
            "length"), "ids_crc32", "sequence_id", "offset")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    return collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text
        FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM pieces, (VALUES (1), (2), (3), (4)) sizes(size)
          WHERE len(w) >= size))
  GROUP BY lang, size, phrase HAVING count(*) >= 30),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w
         FROM counts WHERE size >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
         ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang
    AND r.phrase = array_to_string(w[k + 1:c.size], ' ')),
low AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (
    SELECT *, unnest(range(2, size)) AS s FROM cand WHERE size > 2))),
covered AS (SELECT lang, phrase, max(a) AS cover FROM inner_ GROUP BY ALL),
ranked AS (
  SELECT low.*, row_number() OVER (
    PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN covered v
    ON v.lang = low.lang AND v.phrase = low.phrase
  WHERE cover IS NULL OR 100 * cover < 80 * a)
SELECT r.lang, rank, phrase, a, l, r.r, n, score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_shard_shuffle": op3_shard_shuffle,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_chat_format": op5_chat_format,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_mix_sources": OP2_SQL,
    "op4_warc_revisits": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_centroid_clusters": _op11_sql(),
    "op13_collocations": OP13_SQL,
}
