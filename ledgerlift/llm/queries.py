"""One query per operator, with production settings, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.llm import decontaminate, extract, minhash, near, packing, periodic, pii, quality, repeats, toxicity, tries, url_filter, warc
from ledgerlift.llm.common import table
from ledgerlift.session import stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: For the registered queries alone: anyone who reads this can undo their pseudonyms.
PII_KEY = b"ledgerlift demonstration key"
#: Setting that holds a deployment's own key, in hexadecimal.
PII_KEY_SETTING = "spark.ledgerlift.piiKey"


def pii_key(spark: SparkSession) -> bytes:
    """The session's own key, or the demonstration key where it has none."""
    own = spark.conf.get(PII_KEY_SETTING, None)
    return bytes.fromhex(own) if own else PII_KEY


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


_WORDS_SQL = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query("op1_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL.format(t="coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
       FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
       FROM d, sizes WHERE len(w) >= size),
found AS (SELECT dw.doc_id, dw.pos, dw.size, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))


@_query("op2_quality_rules", r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines
        FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 4),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             len(list_filter(w, lambda x: strlen(x) > 2 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_capital_words,
             list_sum(list_transform(range(0, len(w), 1000), lambda i: len(list_distinct(w[i + 1:i + 1000])))) AS n_window_distinct
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_capital_words > 30 * n_words OR 100 * n_dup_lines > 40 * n_lines
            OR (n_words >= 20 AND 100 * n_window_distinct < 30 * n_words)) AS kept
FROM j
""")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, drop=("text",)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op3_pseudonyms")
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark)).withColumn("n_replaced", F.size("pseudonyms").cast("bigint"))


@_query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op5_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), stage_path(spark, "archive"))


@_query("op9_url_filter", r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
k AS (SELECT *, host || path AS s, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label FROM r),
t AS (SELECT DISTINCT s, label, CAST('0x' || substr(md5(s), 1, 6) AS BIGINT) % 5 = 0 AS held FROM k),
g AS (SELECT s, label, held, substr(repeat(chr(2), 4) || s || chr(3), i, 5) AS gram FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM t)),
n AS (SELECT gram, count(CASE WHEN label = 'allow' AND NOT held THEN 1 END) AS a, count(CASE WHEN label = 'block' AND NOT held THEN 1 END) AS b FROM g GROUP BY gram),
o AS (SELECT gram, a, b, k, substr(gram, 5 - k, k + 1) AS tail FROM (SELECT *, unnest(range(0, 5)) AS k FROM n)),
tails AS (SELECT k, tail, substr(tail, 1, k) AS context, sum(a) AS a, sum(b) AS b FROM o GROUP BY k, tail),
contexts AS (SELECT k, context, sum(a) AS ta, sum(b) AS tb, count(CASE WHEN a > 0 THEN 1 END) AS ka, count(CASE WHEN b > 0 THEN 1 END) AS kb FROM tails GROUP BY k, context),
share AS (SELECT k, tail, CASE WHEN ta = 0 THEN 0 ELSE a / (ta + ka) END AS oa, CASE WHEN ta = 0 THEN 1 ELSE ka / (ta + ka) END AS ra,
                 CASE WHEN tb = 0 THEN 0 ELSE b / (tb + kb) END AS ob, CASE WHEN tb = 0 THEN 1 ELSE kb / (tb + kb) END AS rb FROM tails JOIN contexts USING (k, context)),
steps AS (SELECT gram, list(oa ORDER BY k) AS oa, list(ra ORDER BY k) AS ra, list(ob ORDER BY k) AS ob, list(rb ORDER BY k) AS rb FROM o JOIN share USING (k, tail) GROUP BY gram),
scores AS (SELECT gram, ln(oa[5] + ra[5] * (oa[4] + ra[4] * (oa[3] + ra[3] * (oa[2] + ra[2] * (oa[1] + ra[1] / 256.0)))))
                      - ln(ob[5] + rb[5] * (ob[4] + rb[4] * (ob[3] + rb[3] * (ob[2] + rb[2] * (ob[1] + rb[1] / 256.0))))) AS score FROM steps),
per AS (SELECT s, label, avg(score) AS score FROM g JOIN scores USING (gram) WHERE label IS NULL OR held GROUP BY s, label),
bins AS (SELECT CAST(greatest(-5000, least(5000, round(score * 500))) AS INTEGER) AS step, count(CASE WHEN label = 'allow' THEN 1 END) AS a, count(CASE WHEN label = 'block' THEN 1 END) AS b
         FROM per WHERE label IS NOT NULL GROUP BY 1),
cuts AS (SELECT (step + coalesce(lag(step) OVER w, step)) / 2.0 / 500 AS at_score, step,
                (sum(a) OVER () - (sum(a) OVER w - a)) / sum(a) OVER () + (sum(b) OVER w - b) / sum(b) OVER () AS rate FROM bins WINDOW w AS (ORDER BY step)),
lim AS (SELECT coalesce((SELECT at_score FROM cuts WHERE (SELECT min(x) FROM (SELECT sum(a) AS x FROM bins UNION ALL SELECT sum(b) FROM bins)) > 0 ORDER BY rate DESC, step LIMIT 1), 0) AS v,
               (SELECT count(DISTINCT label) FROM t WHERE NOT held AND label IS NOT NULL) = 2 AS usable)
SELECT page_id, host, path, rule, coalesce(k.label, CASE WHEN usable AND per.score < v THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN per ON per.s = k.s AND k.label IS NULL CROSS JOIN lim
""")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("score", "url")


@_query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query("op7_ngram_join", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
""")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


@_query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op11_filter_audit", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
m AS (SELECT doc_id, part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
             + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
             + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o(filter_order, step, bit, earlier) AS (
  SELECT '', 0, 0, 0
  UNION ALL SELECT filter_order || substr('ABCDE', k, 1), step + 1, 1 << (k - 1), earlier | bit FROM o, range(1, 6) r(k) WHERE ((earlier | bit) >> (k - 1)) & 1 = 0),
whole AS (SELECT filter_order AS whole FROM o WHERE step = 5),
s AS (SELECT whole AS filter_order, step, bit, earlier FROM whole JOIN o ON step > 0 AND starts_with(whole, o.filter_order)),
parts AS (SELECT DISTINCT part FROM c)
SELECT c.part, s.filter_order, CAST(s.step AS INTEGER) AS step,
       CAST(sum(CASE WHEN c.mask & (s.earlier | s.bit) = 0 THEN c.n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.earlier = 0 THEN c.n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.earlier <> 0 THEN c.n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN c.mask = s.bit THEN c.n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.earlier = 0 THEN c.good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.earlier = 0 THEN c.toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & s.earlier = 0 THEN c.n ELSE 0 END)) OVER (PARTITION BY c.part, s.bit) AS BIGINT) AS shapley
FROM c, s GROUP BY c.part, s.filter_order, s.step, s.bit, s.earlier
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the check sum of its id, with its words periodic from one word on."""
    rows = docs.withColumn("__h", F.crc32(F.col("doc_id").cast("string"))).withColumn("__g", F.floor(F.col("__h") / 10).cast("bigint"))
    rows = rows.withColumn("__w", F.when(F.col("__h") % 10 == 0, F.expr(r"filter(split(text, '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')")))
    rows = rows.withColumn("__n", F.when(F.size("__w") > 0, F.size("__w").cast("bigint"))).withColumn("__a", F.col("__g") % F.col("__n"))
    rows = rows.withColumn("__p", F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)).cast("bigint") + 1)
    planted = F.expr("array_join(transform(sequence(0L, __n - 1), i -> __w[cast(if(i < __a, i, __a + (i - __a) % __p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("__n").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs", r"""
WITH k AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda e, j: CASE WHEN e % 2 = 1 THEN xor(e // 2, 3988292384) ELSE e // 2 END)), 4294967295) AS h
           FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM k),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS period FROM p),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % period END]) ELSE w END AS w FROM q),
g AS (SELECT doc_id, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda i: array_to_string(w[i + 1:i + 6], ' '))) AS gram FROM d WHERE n >= 12),
s AS (SELECT a.doc_id, a.i, b.i - a.i AS lag FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i),
e AS (SELECT doc_id, lag, min(i) AS start, count(*) + 5 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM s) GROUP BY doc_id, lag, island),
r AS (SELECT doc_id, start, size + lag AS length, min(lag) AS period FROM e WHERE size >= greatest(lag, 12 - lag) GROUP BY doc_id, start, size + lag),
t AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best,
             string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
       CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    told = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@_query("op13_minhash_dedup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
""")
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))
