"""The operators' queries, applied to whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import conversation_repair, decontaminate, exact_dedup, hard_negatives, html_extract, license_scan, lm_score, mixing, secret_scan, simhash, substring_dedup, toxicity, url_filter
from quillstone.session import table

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["place"] < len(secret_scan.BASE))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["place"] == k)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("_spans")).alias("spans"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Learnt from the labels of documents whose crc32 mod 4 is not 2."""
    labels = table(spark, sf_dir, "labels").filter(toxicity.remainder("doc_id", 4) != 2)
    return toxicity.fit(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", (toxicity.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair(conversation_repair.damage(rows), rows)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_url_filter, op3_lm_score, op4_html_extract, op5_exact_dedup, op6_secret_scan, op7_decontaminate, op8_substring_dedup, op9_toxicity, op10_simhash, op11_license_scan, op12_hard_negatives, op13_conversation_repair)}


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h,
                  CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s FROM documents),
p AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY s) - 1) % 3)::INT + 1]::DOUBLE AS w, source_size * 3 AS cap FROM p),
r AS (SELECT *, cap / w AS ratio FROM w),
k AS (SELECT *, row_number() OVER o AS k,
        ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / ((sum(w) OVER ()) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl FROM r WINDOW o AS (ORDER BY ratio, s)),
l AS (SELECT coalesce(arg_min(lvl, k), 0.0) AS lvl FROM k WHERE ratio > lvl),
t AS (SELECT s, source_size, least(cap::DOUBLE, l.lvl * w) AS target FROM k, l),
n AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        row_number() OVER (PARTITION BY d.s ORDER BY size, h, doc_id) AS i FROM d JOIN t USING (s)),
c AS (SELECT *, least(floor(i * rate + {mixing.OFFSET!r}::DOUBLE) - floor((i - 1) * rate + {mixing.OFFSET!r}::DOUBLE), 3)::BIGINT AS copies FROM n)
SELECT doc_id, size::BIGINT AS size, source_size, target, size::BIGINT * copies AS taken, copies FROM c
"""

OP2_SQL = """
WITH rules(host, path, rule, verdict) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, row_number() OVER () AS rn FROM pages),
m AS (SELECT p.rn, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM p JOIN rules r
  ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY p.rn)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rn)
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY g.text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(g.text) AS text_sha256
FROM d JOIN g USING (text)
"""


def _op6_sql() -> str:
    """One branch per rule: gaps and matches are laid end to end, as list prefix sums."""
    branches = []
    for place, r in enumerate(secret_scan.RULES):
        regex, flags = r.regex.replace("'", "''"), "'i'" if r.any_case else "'c'"
        inline = ("(?i)" if r.any_case else "") + regex
        branches.append(f"""
SELECT rn, {place} AS place, '{r.kind}' AS kind, unnest(list_transform(range(1, len(hit) + 1), lambda i: struct_pack(
  s := list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0), n := length(hit[i]), g := length(part[i])))) AS x
FROM (SELECT rn, string_split_regex(text, '{inline}') AS gap, regexp_extract_all(text, '{inline}', 0) AS hit, regexp_extract_all(text, '{inline}', {r.group}) AS part
      FROM d WHERE regexp_matches(text, '{regex}', {flags}))""")
    least = " ".join(f"WHEN {i} THEN {r.min_len}" for i, r in enumerate(secret_scan.RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(branches)}),
f AS (SELECT rn, place, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e FROM m WHERE x.g >= CASE place {least} END),
o AS (SELECT rn, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3) AS base FROM f GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (rn)
"""


#: Every string of either length by its hash; starts less than a length apart make one run.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS x FROM documents),
n AS (SELECT *, octet_length(x) AS n FROM d),
a AS (SELECT rn, i, hash(x[i:i + 399]) AS h FROM (SELECT rn, x, unnest(range(1, n - 398)) AS i FROM n WHERE n >= 400)),
r AS (SELECT rn, i FROM a WHERE h IN (SELECT h FROM a GROUP BY h HAVING count(*) > 1)),
c AS (SELECT rn, i, i > coalesce(lag(i) OVER (PARTITION BY rn ORDER BY i) + 400, 0) AS fresh FROM r),
g AS (SELECT rn, i, sum(fresh::INT) OVER (PARTITION BY rn ORDER BY i) AS g FROM c),
runs AS (SELECT rn, g, min(i) AS s, max(i) + 399 AS e FROM g GROUP BY rn, g),
edge AS (SELECT rn, s, e, coalesce(lag(e) OVER (PARTITION BY rn ORDER BY s), 0) + 1 AS f FROM runs),
piece AS (SELECT rn, f, s - 1 AS l FROM edge UNION ALL SELECT rn, max(e) + 1, 1000000000 FROM runs GROUP BY rn),
kept AS (SELECT rn, string_agg(CASE WHEN least(l, n) >= f THEN hex(x[f:least(l, n)]) ELSE '' END, '' ORDER BY f) AS k FROM piece JOIN n USING (rn) GROUP BY rn),
removed AS (SELECT rn, sum(e - s + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY rn),
b AS (SELECT rn, i, hash(x[i:i + 255]) AS h FROM (SELECT rn, x, unnest(range(1, n - 254)) AS i FROM n WHERE n >= 256)),
q AS (SELECT rn, i FROM b WHERE h IN (SELECT h FROM b GROUP BY h HAVING min(rn) < max(rn))),
w AS (SELECT rn, least(256, coalesce(lead(i) OVER (PARTITION BY rn ORDER BY i) - i, 256)) AS len FROM q),
shared AS (SELECT rn, sum(len)::BIGINT AS n_shared FROM w GROUP BY rn)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_removed > 0 THEN sha256(unhex(k)) ELSE sha256(t) END AS kept_sha256, coalesce(n_shared, 0) AS n_shared
FROM n LEFT JOIN removed USING (rn) LEFT JOIN kept USING (rn) LEFT JOIN shared USING (rn)
"""


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rn, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.rn <> b.rn WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, id) AS k FROM s WHERE alike QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.rn, p.k ORDER BY s.score DESC, s.id)::INT AS rank FROM p JOIN s ON p.rn = s.rn AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def _op13_sql() -> str:
    """The DP over turns: cells of (cost, audit, repaired text) for the states start, after system, user and assistant."""
    put = lambda cell, cost, letter, line="": f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || '{letter}', 't': {cell}.t{' || ' + line if line else ''}}}"
    none = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    closed2 = f"list_min([s2, {put('s0', 5, 'I', user)}, {put('s1', 5, 'I', user)}, {put('s3', 5, 'I', user)}])"
    closed3 = f"list_min([s3, {put('s2', 5, 'I', assistant)}, {put('s0', 10, 'II', user + ' || ' + assistant)}, {put('s1', 10, 'II', user + ' || ' + assistant)}])"
    taken = lambda cell, initial, name: (
        f"CASE WHEN r.gone THEN {none} WHEN r.initial = '{initial}' THEN {put(cell, 'r.more', 'K', 'chr(10) || r.role || chr(58) || r.text')} ELSE {put(cell, '1 + r.more', 'R', f'chr(10) || {name!r} || chr(58) || r.text')} END"
    )
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
x AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 20 AS d FROM c),
y AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE d <> 0),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, left(role, 1) AS initial FROM y),
r AS (SELECT *, core = '' AS blank, core <> '' AND again AS duplicate, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS truncated, core = '' OR again AS gone,
  CASE WHEN core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM z),
e AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM e
  UNION ALL
  SELECT w.conv_id, r.i, {put('s0', 2, 'D')}, list_min([{put('s1', 2, 'D')}, CASE WHEN r.gone OR r.initial <> 's' THEN {none} ELSE {put('s0', 'r.more', 'K', 'chr(10) || r.role || chr(58) || r.text')} END]),
    list_min([{put('p2', 2, 'D')}, {taken('list_min([s0, s1, p3])', 'u', 'user')}]), list_min([{put('p3', 2, 'D')}, {taken('p2', 'a', 'assistant')}])
  FROM (SELECT *, {closed2} AS p2, {closed3} AS p3 FROM walk) w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
f AS (SELECT conv_id, arg_max(list_min([s0, {closed3}]), i) AS o FROM walk GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, o.c AS cost, o.a AS audit, sha256(substr(o.t, 2)) AS repaired_sha256
FROM f LEFT JOIN g ON f.conv_id IS NOT DISTINCT FROM g.conv_id
"""


SQL = {"op1_mixing": OP1_SQL, "op2_url_filter": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_secret_scan": _op6_sql(), "op8_substring_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL, "op13_conversation_repair": _op13_sql()}
