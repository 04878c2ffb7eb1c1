"""The registered queries of the text operators and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from moteflow.llm import collocations, decontaminate, filter_audit, hidden_markov, html_blocks, license_diagonals, line_runs, lsh_forest, pairwise_quality, poisson_mix, ppm_language, secret_ledger, threshold_topk
from moteflow.llm.common import held_out
from moteflow.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_line_runs", rf"""
WITH x AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
l AS (SELECT doc_id, no, line, len(regexp_extract_all(line, '[^ 	-
]+')) AS w FROM x),
p AS (SELECT doc_id, no, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY no) AS c FROM l WHERE w > 0),
f AS (SELECT a.doc_id, a.p AS s, min(b.p) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.c - a.c + a.w >= 50 GROUP BY 1, 2),
b AS (SELECT b.doc_id, max(a.p) AS s, b.p AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49 AND b.c - a.c + a.w >= 50 GROUP BY 1, 3),
v AS (SELECT * FROM f UNION SELECT doc_id, s, e FROM b),
t AS (SELECT v.doc_id, s, e, string_agg(line, chr(10) ORDER BY p) AS run FROM v JOIN p ON v.doc_id = p.doc_id AND p.p BETWEEN s AND e GROUP BY 1, 2, 3),
k AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS n FROM t),
g AS (SELECT DISTINCT p.doc_id, p.no FROM k JOIN p ON k.doc_id = p.doc_id AND p.p BETWEEN s AND e WHERE n > 1),
r AS (SELECT l.doc_id, count(*) FILTER (w > 0) AS n_lines, count(g.no) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (g.no IS NULL) AS rest
      FROM l LEFT JOIN g USING (doc_id, no) GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS text_sha256 FROM documents d LEFT JOIN r USING (doc_id)""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return line_runs.dedup_lines(table(spark, sf, "documents").select("doc_id", "text")) \
        .select("doc_id", F.col("lines_seen").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op2_ppm_language")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    trees = ppm_language.fit_trees(docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), 3, 1)))
    return ppm_language.identify(docs.select("doc_id", "text"), trees) \
        .select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits"))


@query("op3_lsh_forest", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a),
c AS (SELECT node AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf, "documents"), 3, 85)


@query("op4_threshold_topk", """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return threshold_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op5_hidden_markov")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return hidden_markov.score_texts(table(spark, sf, "documents"), held_out(F.col("doc_id"), 5, 1)) \
        .select("doc_id", F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), "train_tokens", "base_score", "score")


@query("op6_pairwise_quality")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), 5, 0))
    ranker = pairwise_quality.fit_ranker(docs, labels)
    return pairwise_quality.score_quality(docs, ranker) \
        .select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("quality_score").alias("score"),
                (F.col("quality_score") >= pairwise_quality.CUT).cast("int").alias("predicted"))


def _labels(base: bool):
    chosen = F.filter("spans", lambda s: s["base"]) if base else F.col("spans")
    return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda s: s["label"]))), ",")


@query("op7_license_diagonals")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    firsts = F.transform(base, lambda s: s["first"])
    return license_diagonals.scan_licenses(table(spark, sf, "documents").select("doc_id", "text")) \
        .select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
                _labels(True).alias("base_labels"), _labels(False).alias("labels"),
                F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"))


@query("op8_fm_decontamination", rf"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[k:least(k + 9, len(w))], ' ') AS g, least(10, len(w)) AS n
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, k, win.n FROM g JOIN win ON g.g = win.g AND g.n = win.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n_hit = F.aggregate("text_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return decontaminate.find_contamination(docs, table(spark, sf, "benchmark")) \
        .select("doc_id", F.col("text_words").alias("n_words"), n_hit.alias("n_hit"), F.size("text_items").cast("long").alias("n_items"),
                F.sha2(F.array_join("text_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _spans(kinds: tuple[str, ...]):
    chosen = F.filter("findings", lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


_RULES = ", ".join("('{}', {}, '{}')".format(k, secret_ledger.KINDS.index(k), p.pattern.decode().replace("'", "''")) for k, p in
                   [("assign", secret_ledger.ASSIGN), ("access", secret_ledger.ACCESS), ("hex", secret_ledger.HEX), *((k, p) for k, _, p in secret_ledger.MORE)])


@query("op9_secret_ledger", f"""
WITH k(kind, ord, pat) AS (VALUES {_RULES}),
t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
m AS (SELECT text, kind, ord, regexp_extract_all(text, pat) AS m, string_split_regex(text, pat) AS g FROM t, k WHERE regexp_matches(text, pat)),
p AS (SELECT text, kind, ord, m[i] AS m, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT text, kind, ord, s, s + length(m) AS e FROM p WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, (SELECT pat FROM k WHERE kind = 'assign'), 1)) >= 12 WHEN 'access' THEN length(m) >= 18 ELSE true END),
a AS (SELECT text, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       NOT EXISTS (SELECT 1 FROM documents o WHERE o.source = (SELECT max(source) FROM documents) AND coalesce(o.text, '') = coalesce(d.text, '')) AS scanned
FROM documents d LEFT JOIN a ON a.text = coalesce(d.text, '')""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """One ledger over two versions of the corpus: first the documents of the source that was added last (the greatest name), then all. ``scanned`` is false for rows whose
    blob the first version held already."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    ledger = f"{checkpoint_dir(spark).rstrip('/')}/secret_ledger/{uuid.uuid4().hex}"
    newest = docs.agg(F.max("source")).first()[0]
    secret_ledger.scan_secrets(docs.where(F.col("source") == newest), ledger)
    found = secret_ledger.scan_secrets(docs, ledger)
    n = [F.expr(f"CAST(size(filter(findings, f -> f.kind = '{k}')) AS BIGINT) AS n_{k}") for k in secret_ledger.BASE]
    return found.select("doc_id", *n, F.sha2(_spans(secret_ledger.BASE), 256).alias("base_sha256"), _spans(secret_ledger.KINDS).alias("spans"), "scanned")


_TARGETS = ", ".join(f"('{g}', {w})" for g, w in poisson_mix.TARGETS.items())


@query("op10_poisson_mix", f"""
WITH w(g, w) AS (VALUES {_TARGETS}, (NULL, {poisson_mix.REST})),
d AS (SELECT doc_id, source, length(text) AS n, CASE WHEN source IN (SELECT g FROM w) THEN source END AS g FROM documents),
s AS (SELECT g, sum(n) AS n FROM d GROUP BY 1),
r AS (SELECT s.g, CAST({poisson_mix.EPOCHS} AS DOUBLE) * CAST(w AS DOUBLE) / sum(CAST(w AS DOUBLE)) OVER () * sum(n) OVER () / n AS rate FROM s JOIN w ON s.g IS NOT DISTINCT FROM w.g WHERE n > 0),
c AS (SELECT g, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS cdf FROM r, range(0, 400) t(k) WHERE k < rate + 12 * sqrt(rate) + 40),
u AS (SELECT doc_id, source, g, CAST('0x' || substr(md5('{poisson_mix.SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM d),
n AS (SELECT doc_id, source, count(*) FILTER (cdf <= u) AS n FROM u JOIN c ON u.g IS NOT DISTINCT FROM c.g GROUP BY 1, 2)
SELECT doc_id, source, CAST(k AS INTEGER) AS copy, md5('{poisson_mix.SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)) AS shuffle_key
FROM (SELECT doc_id, source, unnest(generate_series(1, n)) AS k FROM n WHERE n > 0)""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return poisson_mix.mix(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "copy", "shuffle_key")


@query("op11_filter_tries", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, false)::INT AS m
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY 1, 2),
s AS (SELECT unnest(string_split('ABCDE', '')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT o, i, CAST(pow(2, instr('ABCDE', o[i]) - 1) AS INT) AS bit, CAST(list_sum([0] || [pow(2, instr('ABCDE', y) - 1) FOR y IN string_split(o[1:i - 1], '') IF y <> '']) AS INT) AS before
      FROM o, range(1, 6) t(i)),
r AS (SELECT part, o, i, bit, sum(n) FILTER (m & (bit | before) = 0) AS kept, sum(n) FILTER (m & bit <> 0 AND m & before = 0) AS removed, sum(n) FILTER (m & bit <> 0 AND m & before <> 0) AS redundant,
             sum(n) FILTER (m = bit) AS unique_fails, sum(good) FILTER (m & bit <> 0 AND m & before = 0) AS good_lost, sum(bad) FILTER (m & bit <> 0 AND m & before = 0) AS toxic_lost
      FROM c, p GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, CAST(i AS INTEGER) AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf, "documents").select("doc_id", "text", "source"), table(spark, sf, "labels"))


@query("op12_word_graph", rf"""
WITH RECURSIVE p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, range(1, 4) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT lang, phrase, max(f) AS m FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE m IS NULL OR k = 3 OR 100 * m < 50 * f),
u AS (SELECT lang, phrase, f, k, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM o)),
s AS (SELECT u.lang, u.phrase, u.f AS a, l.f AS l, r.f AS r, j, CAST(1000000::HUGEINT * u.f * u.f // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp AND l.k = u.j JOIN f r ON r.lang = u.lang AND r.phrase = u.rp AND r.k = u.k - u.j),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b),
k AS (SELECT e.lang, e.f, array_to_string(e.w[1:2], ' ') AS u, array_to_string(e.w[2:3], ' ') AS v FROM c e JOIN c x ON e.k = 3 AND x.lang = e.lang AND x.phrase = array_to_string(e.w[1:2], ' ') AND x.f = e.f
      JOIN c y ON y.lang = e.lang AND y.phrase = array_to_string(e.w[2:3], ' ') AND y.f = e.f WHERE x.phrase <> y.phrase),
h AS (SELECT lang, f, u AS path, u AS node FROM k WHERE NOT EXISTS (SELECT 1 FROM k z WHERE z.lang = k.lang AND z.v = k.u) UNION ALL SELECT h.lang, h.f, path, v FROM h JOIN k ON k.lang = h.lang AND k.u = h.node),
q AS (SELECT *, count(*) OVER (PARTITION BY lang, path) + 1 AS path_words FROM h)
SELECT t.lang, rank, t.phrase, a, l, r, n, score, CASE WHEN x.path = y.path THEN x.path_words ELSE t.k END AS path_words
FROM (SELECT *, len(string_split(phrase, ' ')) AS k FROM t) t JOIN n ON n.lang = t.lang LEFT JOIN q x ON x.lang = t.lang AND x.f = a AND x.node = array_to_string(string_split(t.phrase, ' ')[1:2], ' ')
LEFT JOIN q y ON y.lang = t.lang AND y.node = array_to_string(string_split(t.phrase, ' ')[-2:], ' ') WHERE rank <= 2000""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf, "documents").select("text", "lang"))


@query("op13_recurrent_blocks")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_blocks.extract_text(pages, html_blocks.fit_labeller(pages)).withColumn("n_chars", F.length("text").cast("long"))
