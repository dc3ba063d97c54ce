"""One query per operator over its whole table, and its SQL equivalent where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideframe.llm import (audit, crosspoly, decontaminate, langid, linededup, minhash, mixing, quality, sharding, topk,
                           toxicity, urlfilter, whiten)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SHARDS = 24
RULES = [urlfilter.Rule("net", "/", "block"), urlfilter.Rule("example.net", "/en/", "allow"),
         urlfilter.Rule("example.com", "/de/", "block"), urlfilter.Rule("org", "/fr/", "allow")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def judged(scores: DataFrame, folds: int, fold: int) -> DataFrame:
    return scores.select("doc_id", quality.held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_minhash_near_dedup(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), width=2, percent=80)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    rows = quality.labelled(docs, labels, "quality", "doc_id", "text")
    return quality.train(rows.where(~quality.held_out(F.col("doc_id"), 3, 1)))


@query
def op2_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    return judged(quality.score(docs, quality_model(docs, table(spark, sf, "labels"))), 3, 1)


@query
def op3_line_dedup(spark, sf):
    docs = table(spark, sf, "documents")
    out = linededup.cleaned(docs, linededup.build(docs, min_docs=5, min_chars=40))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_sharding(spark, sf):
    text = F.col("text")
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.assign(rows, SHARDS, "doc_id", ("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op5_url_filter(spark, sf):
    return urlfilter.judge(table(spark, sf, "pages").select("page_id", "url"), RULES) \
        .select("page_id", "host", "path", "rule", "verdict")


@query
def op6_embedding_near_dedup(spark, sf):
    return crosspoly.near_vectors(table(spark, sf, "embeddings"), cosine=0.95)


@query
def op7_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    out = quality.held_out(F.col("doc_id"), 3, 1)
    found = langid.detect(docs, langid.train(docs.where(~out).select("lang", "text")))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op8_decontamination(spark, sf):
    found = decontaminate.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"),
                                                  F.max("item_tokens").cast("long").alias("item_tokens"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Lexicon from remainders 1 to 3 of the labelled rows, curve from remainder 4."""
    rows = quality.labelled(docs, labels, "toxic", "doc_id", "text")

    def fold(n: int) -> Column:
        return quality.held_out(F.col("doc_id"), 5, n)

    return toxicity.train(rows.where(fold(1) | fold(2) | fold(3)), rows.where(fold(4)))


@query
def op9_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return judged(toxicity.score(docs, toxicity_model(docs, table(spark, sf, "labels"))), 5, 0)


@query
def op10_mixing(spark, sf):
    rows = mixing.drawn(table(spark, sf, "documents"), carry=False)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.round("_target", 6).alias("target"), (F.col("_size") * F.size("_shards")).cast("long").alias("taken"))


@query
def op11_filter_audit(spark, sf):
    return audit.interactions(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op12_whitening(spark, sf):
    return whiten.whitened(table(spark, sf, "embeddings"))


@query
def op13_top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
reach AS (SELECT id, id AS c FROM nodes UNION SELECT e.b, r.c FROM reach r JOIN links e ON e.a = r.id),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
"""

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id AS id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t
  FROM documents),
sets AS MATERIALIZED (
  SELECT id, list_distinct(CASE WHEN len(t) < 2 THEN t ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS s
  FROM words),
nodes AS (SELECT id, len(s) AS n FROM sets),
grams AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS MATERIALIZED (
  SELECT x.id AS a, y.id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.id <> y.id
   AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs),{_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN least USING (id)""",
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS MATERIALIZED (SELECT doc_id, i, line, {_FOLD.format("regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')")} AS k FROM lines),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT x.doc_id, x.i, x.line, o.last IS NOT NULL AND o.last <> x.doc_id AS away FROM keyed x LEFT JOIN often o ON x.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (away) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT away), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_url_filter": f"""
WITH rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(h, p, v)),
parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, {_FOLD.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT page_id, max(struct_pack(n := length(h || p), rule := h || p, v := v)) AS best
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM urls LEFT JOIN fits USING (page_id)""",
    "op6_embedding_near_dedup": f"""
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.95),
many AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a),{_REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM nodes JOIN least USING (id) LEFT JOIN many USING (id)""",
}


def _op4_sql() -> str:
    """Jump hashing as a recursion over each id's draws, and crc32 byte by byte."""
    key = "(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 16))::UBIGINT)::HUGEINT"

    def jumps(name: str, shards: int) -> str:
        return f"""
{name} AS (
  SELECT doc_id, {key} AS k, 0::BIGINT AS b, 0::BIGINT AS j FROM ids
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / (((k2 // 8589934592) + 1)::DOUBLE)))::BIGINT
  FROM (SELECT doc_id, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM {name} WHERE j < {shards})),
{name}_last AS (SELECT doc_id, max(j) FILTER (j < {shards}) AS s FROM {name} GROUP BY doc_id)"""

    table_ = "list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, x: " \
             "CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END))"
    return f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents),{jumps("here", SHARDS)},{jumps("grown", SHARDS + 1)},
codes AS MATERIALIZED (SELECT {table_} AS t),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS l FROM documents),
sums AS (SELECT doc_id, n, n + 8 AS size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, l),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc FROM bytes, codes)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, here_last.s::INT AS shard,
  row_number() OVER (PARTITION BY here_last.s ORDER BY
    substr(md5(md5(CAST(doc_id AS VARCHAR)) || ':' || md5(CAST(crc AS VARCHAR)) || ':' || md5(CAST(n + 8 AS VARCHAR))), 17, 3), doc_id, crc, n) - 1 AS slot,
  grown_last.s::INT AS grown_shard
FROM sums JOIN here_last USING (doc_id) JOIN grown_last USING (doc_id)"""


def _op8_sql() -> str:
    """The rule itself, without masks. Of w tokens with so many equal, the others cut the equal ones into
    w - need + 1 runs, so one run has ``n`` tokens at least: alignments that share none cannot count."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    w = decontaminate.WINDOW

    def runs(source: str) -> str:
        return f"SELECT id, n, p, array_to_string(t[p + 1:p + n], ' ') AS run FROM (SELECT id, t, n, unnest(range(0, len(t) - n + 1)) AS p FROM {source})"

    return f"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, {split} AS t FROM documents),
sized AS (SELECT item_id AS id, {split} AS t, least({w}, len(t)) AS w, ceil(w * 0.75)::INT AS need FROM benchmark),
b AS MATERIALIZED (SELECT id, t, w, need, ceil(need / (w - need + 1))::INT AS n FROM sized WHERE w > 0),
met AS MATERIALIZED (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS shift
  FROM ({runs("(SELECT d.id, t, n FROM d, (SELECT DISTINCT n FROM b))")}) ds JOIN ({runs("b")}) bs USING (n, run)),
laid AS (SELECT doc_id, item_id, len(b.t) AS m, b.w, need,
  list_transform(range(greatest(0, -shift), least(len(b.t), len(d.t) - shift)), lambda i: (b.t[i + 1] = d.t[i + shift + 1])::INT) AS same
  FROM met JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
best AS (SELECT doc_id, item_id, m, need, list_sum(same) AS matched,
  list_max(list_transform(range(1, len(same) - w + 2), lambda i: list_sum(same[i:i + w - 1]))) AS run FROM laid)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(m)::BIGINT AS item_tokens FROM best
WHERE run >= need GROUP BY doc_id, item_id"""


def _op10_sql() -> str:
    """Targets by filling up, passes over the rows in their drawn order."""
    return r"""
WITH rows_ AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
sums AS (SELECT source, sum(size) AS s, count(*) AS n FROM rows_ GROUP BY source),
weighted AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM sums),
filled AS (SELECT *, (1.5 * sum(s) OVER () - coalesce(sum(2.0 * s) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM weighted WINDOW o AS (ORDER BY 2.0 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT f.source, s, n, least(2.0 * s, l * w)::DOUBLE AS target FROM filled f,
  (SELECT first(level ORDER BY 2.0 * s / w, source) FILTER (level * w <= 2.0 * s) AS l FROM filled)),
passes AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole FROM goal),
placed AS (SELECT r.*, p.s, p.target, p.whole, p.target - p.whole * p.s AS rest,
  sum(size) OVER (PARTITION BY r.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM rows_ r JOIN passes p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s::BIGINT AS source_size, round(target, 6) AS target,
  (size * (whole + (2 * start + size < 2 * rest)::INT))::BIGINT AS taken FROM placed"""


def _op11_sql() -> str:
    """Masks as strings of failing letters, all orders by joining the letters."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
cells AS MATERIALIZED (
  SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM {letters} a(l), {letters} b(l), {letters} c(l), {letters} d(l), {letters} e(l)
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s, substr(o, s, 1) AS l, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)),
met AS (SELECT part, o, s, l, n, fails, good, toxic, strpos(fails, l) > 0 AS hit,
  length(translate(fails, before, '')) < length(fails) AS gone FROM cells, steps),
counts AS (SELECT part, o, s, l, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
  sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (fails = l) AS unique_fails,
  sum(n) FILTER (hit AND NOT gone AND good) AS good_lost, sum(n) FILTER (hit AND NOT gone AND toxic) AS toxic_lost
  FROM met GROUP BY part, o, s, l)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM counts"""


SQL |= {
    "op11_filter_audit": _op11_sql(),
    "op13_top_k": """
WITH good AS MATERIALIZED (
  SELECT vec_id AS id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT x.id AS query_id, y.id AS vec_id, list_inner_product(x.v::DOUBLE[], y.v::DOUBLE[])::BIGINT AS score
  FROM good x JOIN good y ON x.id <> y.id WHERE x.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
SQL |= {"op4_sharding": _op4_sql(), "op8_decontamination": _op8_sql(), "op10_mixing": _op10_sql()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
