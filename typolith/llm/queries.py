"""One query for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, decontam, html_mincut, line_rules, secrets, zip_warc
from .line_rules import clean_lines
from .mixing import mix
from .ngram_join import jaccard_classes
from .suffix_bwt import remove_repeats
from .weak_labels import classify


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_mincut.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, so that the sources meet their targets."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_suffix_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes, removed from every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs).select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "keep")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.matches(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs, with_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a package, read back."""
    back = zip_warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, and their links."""
    return jaccard_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by the class model and by the smoothed unigrams of the training documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = brown_lm.fit(docs.where(brown_lm.training("doc_id")))
    out = brown_lm.score(docs, model, counts)
    return out.select("doc_id", (~brown_lm.training("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)
    base = F.filter("found", lambda x: x["rank"] < 3)

    def n(rank: int):
        return F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("long")

    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the mix: sizes and targets."""
    return op2_entropy_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the language model: folds, counts and the smoothed unigrams."""
    out = op9_brown_lm(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_mincut, op2_entropy_mix, op3_suffix_bwt, op4_weak_labels, op5_decontaminate, op6_line_rules, op7_zip_warc, op8_ngram_join, op9_brown_lm, op10_secret_scan, mix_targets, lm_base)}


OP3_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n, hex(b) AS h FROM d),
w AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS k FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS i FROM n WHERE n >= 400)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, i, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS c FROM r)),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS z FROM s UNION ALL SELECT doc_id, max(hi), NULL FROM s GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS h FROM k JOIN n USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: All windows of every text that shares a shingle with an item.
OP5_SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
g AS (SELECT doc_id, p - 1 AS p, array_to_string(ws[p:p + 4], ' ') AS gram, len(ws) - 4 AS size FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM a WHERE len(ws) >= 5)),
m AS (SELECT item_id, gram, count(*) AS k, any_value(size) AS size FROM (SELECT item_id, len(ws) - 4 AS size, array_to_string(ws[p:p + 4], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM i WHERE len(ws) >= 5)) GROUP BY item_id, gram),
c AS (SELECT DISTINCT doc_id, item_id, g.size AS n, m.size AS z FROM g JOIN m USING (gram)),
s AS (SELECT *, unnest(range(0, greatest(1, n - z + 1))) AS s FROM c),
h AS (SELECT s.doc_id, s.item_id, s.s, any_value(z) AS z, any_value(n) AS n, g.gram, least(count(*), any_value(m.k)) AS common FROM s JOIN g ON g.doc_id = s.doc_id AND g.p >= s.s AND g.p < s.s + s.z JOIN m ON m.item_id = s.item_id AND m.gram = g.gram GROUP BY s.doc_id, s.item_id, s.s, g.gram),
f AS (SELECT doc_id, item_id, s, any_value(z) AS z, sum(common) / (any_value(z) + least(any_value(z), any_value(n)) - sum(common)) AS sim FROM h GROUP BY doc_id, item_id, s)
SELECT doc_id, item_id, round(sim, 6) AS similarity, s AS first_word, CAST(z + 4 AS BIGINT) AS n_words FROM f WHERE sim >= 0.8 - 1e-12 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, s) = 1"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best,
      array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest
      FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b"""


# Links between different gram sets, by a join on grams; classes by the transitive closure.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS grams
  FROM w),
c AS (SELECT grams, min(doc_id) AS rep, count(*) AS copies, len(grams) AS n FROM s WHERE len(grams) > 0 GROUP BY grams),
g AS (SELECT rep, n, copies, unnest(grams) AS gram FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies
  FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) * 1.8 >= 0.8 * (a.n + b.n) - 1e-9),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a AS rep, count(*) AS n_text_links, sum(copies) AS n_docs FROM p GROUP BY a)
SELECT s.doc_id, coalesce(k.class_id, s.doc_id) AS class_id,
  CAST(coalesce(c.copies - 1, 0) + coalesce(l.n_docs, 0) AS BIGINT) AS n_links,
  coalesce(l.n_text_links, 0) AS n_text_links, coalesce(c.copies, 1) AS n_copies
FROM s LEFT JOIN c ON c.grams = s.grams LEFT JOIN k ON k.rep = c.rep LEFT JOIN l ON l.rep = c.rep"""


_LIST = "['" + "', '".join(line_rules.SEPARATORS) + "']"
_MENU = "['" + "', '".join(line_rules.MENU_WORDS) + "']"
_STOCK = "|".join(line_rules.PHRASES)
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, line, list_sum(list_transform(ws, lambda x: length(x))) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) >= greatest(2, 0.2 * len(ws))
    OR (len(ws) >= 3 AND len(regexp_extract_all(line, '!')) >= 0.5 * len(ws))
    OR (NOT regexp_matches(ws[-1], '([.!?]["'')\]}*_]{0,2}|[…。！？”’›])$') AND len(regexp_extract_all(line, '[.,;:!?]')) * 8 < len(ws))
    OR len(list_filter(ws, lambda x: list_contains(SEPS, x))) >= greatest(2, 0.2 * len(ws))
    OR (len(ws) <= 4 AND len(list_filter(ws, lambda x: list_contains(MENU, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) = len(ws))
    OR (len(ws) >= 5 AND len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) >= 0.4 * len(ws))
    OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'STOCK') AS failed
  FROM l WHERE len(ws) > 0),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS lost_chars FROM f GROUP BY doc_id),
a AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed,
    coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars FROM b LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM a""".replace("SEPS", _LIST).replace("MENU", _MENU).replace("STOCK", _STOCK)


def _spans_sql(name: str, pattern: str, rank: int, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, s, {rank} AS rank, s + length(hit) AS e, hit FROM (
  SELECT doc_id, hits[i] AS hit, vals[i] AS val, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
    SELECT doc_id, parts, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS parts, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {2 if keep != "true" else 0}) AS vals FROM d))) WHERE {keep})"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql("ka", secrets.ASSIGN, 0, "length(val) >= 6")},
{_spans_sql("kc", secrets.ACCESS, 1)},
{_spans_sql("kh", secrets.HEX, 2)},
{_spans_sql("kr", secrets.CANDIDATE, 3)},
base AS (SELECT * FROM ka UNION ALL SELECT * FROM kc UNION ALL SELECT * FROM kh),
part AS (SELECT doc_id, s, e, unnest(string_split_regex(hit, '{secrets.ALLOWED}')) AS hit FROM kr WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = kr.doc_id AND base.s < kr.e AND kr.s < base.e)),
win AS (SELECT doc_id, s, e, substr(hit, CAST(k AS INT), {secrets.WINDOW}) AS w FROM (SELECT *, unnest(range(1, length(hit) - {secrets.WINDOW - 2})) AS k FROM part
  WHERE length(hit) >= {secrets.WINDOW} AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]'))),
ent AS (SELECT DISTINCT doc_id, s, 3 AS rank, e FROM win WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')
  AND list_aggregate(string_split(w, ''), 'entropy') >= CASE WHEN regexp_full_match(w, '[0-9a-fA-F]+') THEN {secrets.HEX_BITS} ELSE {secrets.ANY_BITS} END - 1e-12),
al AS (SELECT doc_id, s, rank, e FROM base UNION ALL SELECT * FROM ent),
tx AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][rank + 1] || ':' || s || ':' || e AS x FROM al)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN tx USING (doc_id) GROUP BY d.doc_id"""


#: Caps are met in the order of cap over weight; the first source whose share stays below its cap gives the common level.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, encode(source) NULLS LAST) AS r FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER b, 0)) AS level FROM o WINDOW b AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level, r FROM l WHERE cap > w * level ORDER BY r LIMIT 1)
SELECT doc_id, size, source_size, round(CASE WHEN r < coalesce((SELECT r FROM f), r + 1) THEN cap ELSE w * (SELECT level FROM f) END, 6) AS target
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source"""

#: crc32 byte by byte, from its table.
LM_SQL = r"""
WITH ct AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, x: xor(a >> 8, t[CAST(1 + (xor(a, x) & 255) AS INT)])), 4294967295) % 7 = 2 AS held_out FROM documents, ct),
k AS (SELECT doc_id, held_out, unnest(list_append(ws, chr(10))) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / (n.n + v + 1))), 5) AS base_score
FROM k LEFT JOIN c USING (w), n GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_bwt": OP3_SQL, "op5_decontaminate": OP5_SQL, "op6_line_rules": OP6_SQL, "op7_zip_warc": OP7_SQL, "op8_ngram_join": OP8_SQL, "op10_secret_scan": OP10_SQL, "mix_targets": MIX_SQL, "lm_base": LM_SQL}
