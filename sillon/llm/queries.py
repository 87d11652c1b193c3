"""The registered queries of the text operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillon.sources.tables import table

from . import bpe_codec, decontaminate, divergence, hosts, html_text, langid, media, minhash, negatives, order_minhash, sstable, token_counts, toxicity
from .common import fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(langid.sample(docs.filter(~held_out), "text", "lang"))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "phrase_letters")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages whose document (the number that ends the path) is labelled; bad if toxic or of low quality."""
    number = F.regexp_extract(F.col("url"), r"(?s)^.*?://[^/?#]*/(?:[^/?#]*/)*([0-9]{1,18})(?:\.html)?/?(?:[?#].*)?$", 1)
    pages = table(spark, sf_dir, "pages").select(hosts.host_of(F.col("url")).alias("host"), F.try_to_number(F.nullif(number, F.lit("")), F.lit("9" * 18)).cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    return pages.filter("doc_id is not null").join(labels, "doc_id").select("host", "bad")


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), _page_outcomes(spark, sf_dir))


OP7_SQL = r"""
WITH read AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    try_cast(regexp_extract(url, '^.*?://[^/?#]*/(?:[^/?#]*/)*([0-9]{1,18})(?:\.html)?/?(?:[?#].*)?$', 1, 's') AS BIGINT) AS doc_id
  FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\.+$', '') AS name FROM read),
cut AS (SELECT *, string_split(name, '.') AS ps, regexp_matches(name, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$') AS address FROM named),
counted AS (SELECT *, CASE WHEN array_to_string(ps[greatest(1, len(ps) - 1):], '.') IN (SUFFIXES) THEN 2 ELSE 1 END AS labels FROM cut),
placed AS (
  SELECT page_id, host, path, doc_id, CASE WHEN address THEN name ELSE array_to_string(ps[greatest(1, len(ps) - labels):], '.') END AS domain,
    CASE WHEN address THEN name ELSE array_to_string(ps[greatest(1, len(ps) - labels + 1):], '.') END AS suffix
  FROM counted),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM placed),
marks AS (SELECT doc_id, max(CAST(toxic = 1 OR quality = 0 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM ruled JOIN marks USING (doc_id) WHERE bad IS NOT NULL GROUP BY host),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
t AS (SELECT sum(n) AS n, sum(bad) AS bad FROM s HAVING sum(n) > 0),
sm AS (SELECT suffix, s.n, s.bad, t.bad / t.n AS m FROM s, t),
sw AS (SELECT count(*) AS k, sum(n) AS nn1, sum(n * n) AS nn2, sum(bad * bad / n) AS s2, sum(bad) AS s1, any_value(m) AS m FROM sm),
sv AS (SELECT (s2 - 2 * m * s1 + m * m * nn1 - (k - 1) * m * (1 - m)) / nullif((nn1 - nn2 / nn1) * m * (1 - m), 0) AS share FROM sw),
sp AS (SELECT suffix, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM sm, (SELECT CASE WHEN share > 0 THEN least(1000, greatest(1, 1 / share - 1)) ELSE 1000 END AS w FROM sv)),
dm AS (SELECT d.*, a / (a + b) AS m FROM d JOIN sp USING (suffix)),
dw AS (SELECT suffix, count(*) AS k, sum(n) AS nn1, sum(n * n) AS nn2, sum(bad * bad / n) AS s2, sum(bad) AS s1, any_value(m) AS m FROM dm GROUP BY suffix),
dv AS (SELECT suffix, (s2 - 2 * m * s1 + m * m * nn1 - (k - 1) * m * (1 - m)) / nullif((nn1 - nn2 / nn1) * m * (1 - m), 0) AS share FROM dw),
dp AS (SELECT domain, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM dm JOIN (SELECT suffix, CASE WHEN share > 0 THEN least(1000, greatest(1, 1 / share - 1)) ELSE 1000 END AS w FROM dv) USING (suffix)),
hm AS (SELECT h.*, a / (a + b) AS m FROM h JOIN dp USING (domain)),
hw AS (SELECT domain, count(*) AS k, sum(n) AS nn1, sum(n * n) AS nn2, sum(bad * bad / n) AS s2, sum(bad) AS s1, any_value(m) AS m FROM hm GROUP BY domain),
hv AS (SELECT domain, (s2 - 2 * m * s1 + m * m * nn1 - (k - 1) * m * (1 - m)) / nullif((nn1 - nn2 / nn1) * m * (1 - m), 0) AS share FROM hw),
hp AS (SELECT host, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM hm JOIN (SELECT domain, CASE WHEN share > 0 THEN least(1000, greatest(1, 1 / share - 1)) ELSE 1000 END AS w FROM hv) USING (domain)),
low AS (
  SELECT 'h' AS level, host AS unit, a, b FROM hp UNION ALL SELECT 'd', domain, a, b FROM dp UNION ALL SELECT 's', suffix, a, b FROM sp UNION ALL SELECT 't', '', bad, n - bad FROM t),
blocked AS (SELECT level, unit, a / (a + b) - 1.0 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.4 AS blocked FROM low)
SELECT page_id, ruled.host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN coalesce(bh.blocked, bd.blocked, bs.blocked, bt.blocked, false) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
LEFT JOIN blocked bh ON bh.level = 'h' AND bh.unit = host
LEFT JOIN blocked bd ON bd.level = 'd' AND bd.unit = domain
LEFT JOIN blocked bs ON bs.level = 's' AND bs.unit = suffix
LEFT JOIN blocked bt ON bt.level = 't'
""".replace("SUFFIXES", ", ".join(f"'{x}'" for x in hosts.PUBLIC_SUFFIXES))


#: Fixed value: words of a shingle of the registered query.
OP8_SHINGLE = 2


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), shingle=OP8_SHINGLE)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
t AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, t.y FROM r JOIN t ON t.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""

OP10_SQL = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM words),
i AS (SELECT id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM w WHERE kind = 'b' AND len(ws) > 0),
win AS (SELECT DISTINCT id AS item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS x FROM i),
d AS (SELECT id AS doc_id, ws FROM w WHERE kind = 'd'),
spot AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT doc_id, item_id, p, spot.n FROM spot JOIN win ON win.n = spot.n AND win.x = array_to_string(ws[p:p + spot.n - 1], ' ')),
q AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit),
h AS (SELECT doc_id, count(*) AS n_hit FROM q GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id),
parts AS (SELECT doc_id, string_split(regexp_replace(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), ' ') AS ps FROM documents JOIN h USING (doc_id)),
part AS (SELECT doc_id, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS i FROM parts),
placed AS (SELECT doc_id, i, len(x) AS n, CAST(sum(len(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(x) - 1 AS BIGINT) AS pos FROM part),
numbered AS (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM placed WHERE n > 0),
runs AS (SELECT doc_id, pos, n, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS run FROM numbered JOIN q USING (doc_id, q)),
r AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM (SELECT doc_id, min(pos) AS a, max(pos + n) AS b FROM runs GROUP BY doc_id, run) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(items, '') AS items, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=True)
    return found.withColumns({c: F.array_join(c, ",") for c in ("items", "spans")})


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n, count(DISTINCT row) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM f GROUP BY lang, source),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 5)) // (t.total + 5 * l.v) AS p, 1 + (1000000000 * (f.all_n + 5)) // (l.total + 5 * l.v) AS q
  FROM f JOIN t ON t.lang = f.lang AND t.source = f.source JOIN l ON l.lang = f.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON b.row <> a.row WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5),
n AS (
  SELECT p.anchor, p.row, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id, s.row) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_media_columns, op3_html_text, op4_toxicity, op5_token_counts, op6_token_shards, op7_host_reputation, op8_minhash_near_dedup, op9_bpe_round_trip, op10_decontamination, op11_source_divergence, op12_order_minhash, op13_hard_negatives)
}

ORACLES: dict[str, str] = {"op7_host_reputation": OP7_SQL, "op8_minhash_near_dedup": OP8_SQL, "op10_decontamination": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_hard_negatives": OP13_SQL}
