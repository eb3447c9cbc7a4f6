"""The registered queries: each operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecat.llm import bpe, chat, clusters, itq, merkle, mixing, pii, prefix_counts, quality, repeats, simhash, sketch, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_CONTROLS = ", ".join(f"'{c}'" for c in chat.CONTROL)


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
formed AS (
  SELECT *, CASE WHEN role = 'assistant' THEN '[OUT]' || {_escaped('text')} || '</s>'
    ELSE '[INST]' || replace({_escaped('role')}, chr(10), chr(92) || chr(10)) || chr(10) || {_escaped('text')} || '[/INST]' END AS out
  FROM rows),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, 3 + sum(length(out)) AS formatted_chars
  FROM formed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, -1 AS rewrites_at
FROM told"""


@query("op1_chat_formatting", CHAT_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted and read back."""
    own = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{own}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{own}'")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digests(chat.format_conversations(rows, chat.inst_template, stable=True))


@query("op2_personal_data")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf, "documents"))


@query("op3_forced_boundary_bpe")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), ids=False)


@query("op4_itq_near_duplicates", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
  AND array_inner_product(a.v, b.v) / sqrt(array_inner_product(a.v, a.v)) / sqrt(array_inner_product(b.v, b.v)) >= 0.95),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM e LEFT JOIN n ON vec_id = n.a LEFT JOIN reach ON vec_id = reach.a""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf, "embeddings"))


@query("op5_prefix_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf, "documents"))


@query("op6_temperature_mixing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the mix over all documents, by id."""
    docs = table(spark, sf, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("n_words"))
    rows, _ = mixing.mix_sources(docs, tokens=F.col("n_words"))
    return rows.select("row.doc_id", "source", "tokens", "pass", "block", "slot")


@query("op7_threshold_sketch")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return sketch.compare_edits(table(spark, sf, "documents"))


@query("op8_maximal_repeats")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents"))


@query("op9_site_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its evidence, the posteriors of its site, and the decision.

    The source stands for the host and the language for the path below it."""
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    judged = quality.judge(docs, model, F.col("source"), F.col("lang"), carry=["doc_id"])
    return judged.select("row.doc_id", "host", "path", "evidence", "host_mean", "path_mean", "posterior", "keep")


@query("op10_simhash_near_duplicates")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_block_pruned_top_k", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINE}),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def _part(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_part(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('(n_chars + 1)')} AS bumped, xor(4294967295, list_reduce(list_prepend(
    CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384))) AS crc FROM documents),
p AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, lvl, idx, n, h) AS (SELECT lang, 0, pos, n, leaf FROM p
  UNION ALL SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lang, lvl, n, idx // 2),
s AS (SELECT lang, lvl AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, idx, n, h) AS (SELECT 0, pos, n, subroot FROM s
  UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, n, idx // 2),
way AS (
  SELECT p.rid, l.lvl AS k, (p.pos >> l.lvl) & 1 AS odd, o.h FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
    JOIN (SELECT unnest(range(0, 64)) AS lvl) l ON l.lvl < s.height
    LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.lvl = l.lvl AND o.idx = xor(p.pos >> l.lvl, 1)
  UNION ALL SELECT p.rid, s.height + l.lvl, (s.pos >> l.lvl) & 1, o.h FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
    JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) l ON true LEFT JOIN u o ON o.lvl = l.lvl AND o.idx = xor(s.pos >> l.lvl, 1)),
f(rid, k, h) AS (SELECT rid, 0, CASE WHEN crc % 7 = 0 AND bumped IS NOT NULL THEN bumped ELSE leaf END FROM p
  UNION ALL SELECT f.rid, f.k + 1, sha256(CASE WHEN w.h IS NULL THEN f.h WHEN w.odd = 1 THEN w.h || f.h ELSE f.h || w.h END)
  FROM f JOIN way w ON w.rid = f.rid AND w.k = f.k),
folded AS (SELECT rid, arg_max(h, k) AS folded_root FROM f GROUP BY rid),
proved AS (SELECT p.rid, sha256(coalesce(string_agg(w.h, '' ORDER BY w.k), '')) AS proof_sha256 FROM p LEFT JOIN way w USING (rid) GROUP BY p.rid)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN folded USING (rid) JOIN proved USING (rid)"""


@query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verify(table(spark, sf, "documents"))


def _cluster_sql(rounds: int = 3, k: int = 16) -> str:
    """The rounds one after the other: a<i> assigns to c<i>, c<i + 1> replaces c<i>."""
    out = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINE} AND len(embedding) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, v FROM e QUALIFY c < {k})"""
    for i in range(rounds + 1):
        out += f""",
d{i} AS (SELECT vec_id, e.v, c, CAST(list_sum(list_transform(list_zip(e.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM e, c{i} m),
a{i} AS (SELECT vec_id, v, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)"""
    return out + f"""
SELECT vec_id, a.c AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""


@query("op13_bit_plane_clusters", _cluster_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster(table(spark, sf, "embeddings"))
