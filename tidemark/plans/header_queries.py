"""Header matching over many uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import char_ngrams, clean_name, stable_round
from tidemark.operators import matcher as MT
from tidemark.plans.registry import define_cte, query, rnd, values
from tidemark.sources import uploads as U


def _list(name: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in U.HEADER_LISTS[name].split()) + "]"


def _pick(name: str) -> str:
    return f"{_list(name)}[(pos + dataset_id) % {len(U.HEADER_LISTS[name].split())} + 1]"


define_cte("hdr0", f"""
SELECT *, CASE WHEN dataset_id % 50 = 49 THEN {_pick('ids')} WHEN dataset_id % 4 = 0 THEN {_pick('telco')}
  WHEN dataset_id % 4 = 1 THEN {_pick('bank')} WHEN dataset_id % 4 = 2 THEN {_pick('subscription')} ELSE {_pick('shop')} END AS listed
FROM (SELECT p_partkey // 20 AS dataset_id, CAST(p_partkey % 20 AS INTEGER) AS pos, p_name, p_size FROM part)""")
define_cte("hdr", """
SELECT dataset_id, pos, header, replace(replace(lower(trim(header)), '_', ''), ' ', '') AS clean FROM (
  SELECT dataset_id, pos, CASE WHEN p_size % 10 = 9 AND dataset_id % 50 <> 49 THEN p_name ELSE
    CASE p_size % 6 WHEN 1 THEN upper(listed) WHEN 2 THEN lower(listed) WHEN 3 THEN listed || '_' WHEN 4 THEN ' ' || listed || ' '
      WHEN 5 THEN substr(listed, 1, 1) || substr(listed, 3) ELSE listed END END AS header FROM hdr0)""", "hdr0")


def _strings(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


IDS, TARGETS = _strings(catalog.id_words()), _strings(catalog.target_words())
define_cte("cat", values(
    [(i, ip, p, f, catalog.clean(f), catalog.ROLES[f], str(catalog.DEFAULTS[f]))
     for ip, i in enumerate(catalog.INDUSTRIES) for p, f in enumerate(catalog.SCHEMAS[i])],
    "industry, industry_pos, fpos, feature, fclean, role, default_value"))
define_cte("syn", values([(f, catalog.clean(a), i) for i, (f, a) in enumerate(catalog.lexicon())],
                         "feature, alias_clean, doc"))
define_cte("sig", values([(i, t) for i in catalog.INDUSTRIES for t in catalog.signature_tokens(i)], "industry, token"))


def grams(source: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, substr({text}, i, n) AS gram FROM {source}, (VALUES (2), (3), (4)) AS nn(n), range(1, 80) AS r(i)
  WHERE i + n - 1 <= length({text})"""


define_cte("hdet", f"SELECT * FROM hdr WHERE clean NOT IN {IDS} AND clean NOT IN {TARGETS}", "hdr")
define_cte("hg", f"SELECT dataset_id, pos, gram, count(*) AS tf FROM ({grams('hdr', 'dataset_id, pos', 'clean')}) GROUP BY ALL", "hdr")
define_cte("fg", f"SELECT feature, gram, count(*) AS tf FROM ({grams('(SELECT DISTINCT feature, fclean FROM cat)', 'feature', 'fclean')}) GROUP BY ALL", "cat")
define_cte("adf", f"SELECT gram, count(DISTINCT doc) AS df FROM ({grams('syn', 'doc', 'alias_clean')}) GROUP BY gram", "syn")
define_cte("cg", f"SELECT DISTINCT industry, feature, gram FROM ({grams('cat', 'industry, feature', 'fclean')})", "cat")


def similarity_sql(docs: str, dataset_corpus: str, schema_df: str, n_schema: int, features: str) -> str:
    """Similarity of ``docs`` (dataset_id, pos, clean, wanted) with ``features``.

    ``dataset_corpus`` lists (dataset_id, corpus), ``schema_df`` (corpus, gram, df).
    """
    return f"""
WITH docs AS ({docs}),
nd AS (SELECT dataset_id, corpus, count(*) + {n_schema + len(catalog.lexicon())} AS nn FROM docs JOIN ({dataset_corpus}) USING (dataset_id) GROUP BY ALL),
dd AS (SELECT dataset_id, gram, count(*) AS df FROM hg JOIN docs USING (dataset_id, pos) GROUP BY ALL),
gr AS (SELECT gram FROM hg UNION SELECT gram FROM fg),
idf AS (SELECT dataset_id, gram, ln((1 + nn)::DOUBLE / (1 + coalesce(dd.df, 0) + coalesce(adf.df, 0) + coalesce(sd.df, 0))) + 1 AS w
  FROM nd CROSS JOIN gr LEFT JOIN dd USING (dataset_id, gram) LEFT JOIN adf USING (gram) LEFT JOIN ({schema_df}) sd USING (corpus, gram)),
hn AS (SELECT dataset_id, pos, sqrt(sum(tf * tf * w * w)) AS hnorm FROM hg JOIN docs USING (dataset_id, pos) JOIN idf USING (dataset_id, gram) WHERE wanted GROUP BY ALL),
fs AS (SELECT DISTINCT dataset_id, feature, fclean FROM nd JOIN ({features}) USING (corpus)),
fn AS (SELECT dataset_id, feature, sqrt(sum(tf * tf * w * w)) AS fnorm FROM fs JOIN fg USING (feature) JOIN idf USING (dataset_id, gram) GROUP BY ALL),
dot AS (SELECT hg.dataset_id, pos, fg.feature, sum(hg.tf * fg.tf * w * w) AS s FROM hg JOIN docs USING (dataset_id, pos) JOIN fg USING (gram)
  JOIN fs ON fs.dataset_id = hg.dataset_id AND fs.feature = fg.feature JOIN idf ON idf.dataset_id = hg.dataset_id AND idf.gram = hg.gram WHERE wanted GROUP BY ALL),
lad AS (SELECT dataset_id, pos, feature, CASE WHEN clean = fclean THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS ladder
  FROM docs JOIN fs USING (dataset_id) WHERE wanted AND (clean = fclean OR EXISTS (SELECT 1 FROM syn WHERE syn.feature = fs.feature AND alias_clean = clean)))
SELECT dataset_id, pos, feature, {rnd('coalesce(ladder, s / (hnorm * fnorm), 0)', 9)} AS similarity,
  CASE WHEN ladder = 1 THEN 'exact' WHEN ladder IS NOT NULL THEN 'synonym' ELSE 'ngram' END AS method
FROM dot FULL JOIN lad USING (dataset_id, pos, feature) LEFT JOIN hn USING (dataset_id, pos) LEFT JOIN fn USING (dataset_id, feature)"""


_NEEDS = ("hdr", "hdet", "hg", "fg", "adf", "cg", "cat", "syn")
define_cte("simd", similarity_sql(
    "SELECT dataset_id, pos, clean, true AS wanted FROM hdet",
    "SELECT DISTINCT dataset_id, 'detect' AS corpus FROM hdet",
    "SELECT 'detect' AS corpus, gram, count(*) AS df FROM cg GROUP BY gram", 210,
    "SELECT DISTINCT 'detect' AS corpus, feature, fclean FROM cat"), *_NEEDS)
define_cte("bestm", """
SELECT dataset_id, pos, industry, feature, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, pos, industry ORDER BY similarity DESC, fpos) AS rk
  FROM simd JOIN cat USING (feature) WHERE similarity > 0) WHERE rk = 1""", "simd", "cat")
define_cte("sigh", """
SELECT d.dataset_id, i.industry, i.industry_pos, coalesce(hits, 0) AS hits
FROM (SELECT DISTINCT dataset_id FROM hdet) d CROSS JOIN (SELECT DISTINCT industry, industry_pos FROM cat) i
LEFT JOIN (SELECT dataset_id, industry, count(*) AS hits FROM hdet JOIN sig ON contains(clean, token) GROUP BY ALL) USING (dataset_id, industry)
""", "hdet", "cat", "sig")
define_cte("iscore", f"""
SELECT dataset_id, industry, industry_pos, coalesce(matched, 0) AS matched, coalesce(total_similarity, 0) AS total_similarity, hits,
  {rnd('coalesce(total_similarity, 0) * coalesce(matched, 0) / 21 + hits * 2', 9)} AS score
FROM sigh LEFT JOIN (SELECT dataset_id, industry, count(*) AS matched, sum(similarity) AS total_similarity FROM bestm WHERE similarity > 0.40 GROUP BY ALL)
  USING (dataset_id, industry)""", "sigh", "bestm")
define_cte("det", """
SELECT dataset_id, CASE WHEN score >= 0.1 THEN industry ELSE 'telecom' END AS industry, coalesce(score, 0) AS score
FROM (SELECT DISTINCT dataset_id FROM hdr) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, industry_pos) AS rk FROM iscore) WHERE rk = 1)
  USING (dataset_id)""", "hdr", "iscore")
define_cte("simm", similarity_sql(
    f"SELECT dataset_id, pos, clean, clean NOT IN {IDS} AS wanted FROM hdr",
    "SELECT dataset_id, industry AS corpus FROM det",
    "SELECT industry AS corpus, gram, count(*) AS df FROM cg GROUP BY ALL", 21,
    "SELECT industry AS corpus, feature, fclean FROM cat"), *_NEEDS, "det")
TRUE_IDS = _strings(catalog.true_id_words())
define_cte("mapping", f"""
SELECT dataset_id, pos, header, feature, similarity, method FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, feature ORDER BY late, pos) AS rk FROM (
    SELECT dataset_id, pos, feature, similarity, method, CASE WHEN method = 'exact' THEN 0 ELSE 1 END AS late FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset_id, pos ORDER BY similarity DESC, fpos) AS b
      FROM simm JOIN det USING (dataset_id) JOIN cat USING (industry, feature)) WHERE b = 1 AND similarity > 0.35
    UNION ALL SELECT dataset_id, pos, 'customer_id', 1.0, 'id', CASE WHEN clean IN {TRUE_IDS} THEN 0 ELSE 1 END FROM hdr WHERE clean IN {IDS}))
JOIN hdr USING (dataset_id, pos) WHERE rk = 1""", "simm", "det", "cat", "hdr")


@query("clean_name", ctes=("hdr",), sql="SELECT dataset_id, pos, header, clean FROM hdr")
def clean_name_query(spark, base):
    return U.upload_headers(spark, base).withColumn("clean", clean_name(F.col("header")))


@query("char_ngrams", ctes=("hdr",), sql=f"SELECT gram, count(*) AS n FROM ({grams('hdr', 'dataset_id, pos', 'clean')}) GROUP BY gram")
def char_ngrams_query(spark, base):
    h = MT.with_clean(U.upload_headers(spark, base))
    return h.select(F.explode(char_ngrams(F.col("clean"))).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"))


@query("char_tfidf", ctes=("hdr", "hg"), sql=f"""
WITH n AS (SELECT dataset_id, count(*) AS nn FROM hdr GROUP BY ALL), d AS (SELECT dataset_id, gram, count(*) AS df FROM hg GROUP BY ALL),
w AS (SELECT dataset_id, pos, gram, tf * (ln((1 + nn)::DOUBLE / (1 + df)) + 1) AS x FROM hg JOIN n USING (dataset_id) JOIN d USING (dataset_id, gram))
SELECT dataset_id, pos, gram, {rnd('x / sqrt(sum(x * x) OVER (PARTITION BY dataset_id, pos))', 6)} AS weight FROM w""")
def char_tfidf(spark, base):
    return MT.tfidf(MT.with_clean(U.upload_headers(spark, base))).withColumn(
        "weight", stable_round(F.col("weight"), 6))


@query("synonym_match", ctes=("hdr", "syn"), sql="""
SELECT DISTINCT dataset_id, pos, header, feature FROM hdr JOIN syn ON clean = alias_clean""")
def synonym_match(spark, base):
    return MT.synonym_matches(U.upload_headers(spark, base))


@query("header_similarity", ctes=("simd",), sql=f"SELECT dataset_id, pos, feature, {rnd('similarity', 6)} AS similarity, method FROM simd")
def header_similarity(spark, base):
    sims = MT.similarities(MT.detection_headers(U.upload_headers(spark, base)), ("detect",))
    return sims.withColumn("similarity", stable_round(F.col("similarity"), 6))


@query("header_best_match", ctes=("bestm",), sql=f"SELECT dataset_id, pos, industry, feature, {rnd('similarity', 6)} AS similarity FROM bestm")
def header_best_match(spark, base):
    return MT.best_matches(U.upload_headers(spark, base)).withColumn(
        "similarity", stable_round(F.col("similarity"), 6))


@query("signature_counts", ctes=("sigh",), sql="SELECT dataset_id, industry, hits FROM sigh")
def signature_counts(spark, base):
    return MT.signature_hits(U.upload_headers(spark, base))


@query("industry_scores", ctes=("iscore",), sql=f"SELECT dataset_id, industry, matched, {rnd('total_similarity', 6)} AS total_similarity, hits, {rnd('score', 6)} AS score FROM iscore")
def industry_scores(spark, base):
    return MT.industry_scores(U.upload_headers(spark, base)).withColumns({
        c: stable_round(F.col(c), 6) for c in ("total_similarity", "score")})


@query("match_details", ctes=("bestm", "sigh", "hdr"), sql=f"""
WITH m AS (SELECT * FROM bestm WHERE similarity > 0.40),
t AS (SELECT dataset_id, industry, count(*) AS matched, sum(similarity) AS total_similarity FROM m GROUP BY ALL),
f AS (SELECT dataset_id, industry, string_agg(header || ' > ' || feature || ' ' || CAST({rnd('similarity', 3)} AS VARCHAR), ' / ' ORDER BY pos) AS details
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, industry ORDER BY pos) AS place FROM m) JOIN hdr USING (dataset_id, pos) WHERE place <= 5 GROUP BY ALL),
x AS (SELECT dataset_id, industry, industry_pos, coalesce(matched, 0) AS matched, coalesce(total_similarity, 0) AS total_similarity,
  {rnd('coalesce(total_similarity, 0) * coalesce(matched, 0) / 21', 9)} AS score, coalesce(details, '') AS details
  FROM sigh LEFT JOIN t USING (dataset_id, industry) LEFT JOIN f USING (dataset_id, industry))
SELECT dataset_id, industry, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, industry_pos) AS INTEGER) AS rank, matched,
  {rnd('total_similarity', 6)} AS total_similarity, {rnd('score', 6)} AS score, details FROM x""")
def match_details(spark, base):
    text = F.transform("details", lambda d: F.concat(d["header"], F.lit(" > "), d["feature"], F.lit(" "), d["similarity"].cast("string")))
    return MT.match_details(U.upload_headers(spark, base)).withColumns({
        "total_similarity": stable_round(F.col("total_similarity"), 6), "score": stable_round(F.col("score"), 6),
        "details": F.array_join(text, " / ")})


@query("detect_industry", ctes=("det",), sql=f"SELECT dataset_id, industry, {rnd('score', 6)} AS score FROM det")
def detect_industry(spark, base):
    return MT.detect_industries(U.upload_headers(spark, base)).withColumn("score", stable_round(F.col("score"), 6))


@query("column_mapping", ctes=("mapping",), sql=f"SELECT dataset_id, pos, header, feature, {rnd('similarity', 6)} AS similarity, method FROM mapping")
def column_mapping(spark, base):
    h = U.upload_headers(spark, base)
    return MT.column_mapping(h, MT.detect_industries(h)).withColumn("similarity", stable_round(F.col("similarity"), 6))


@query("detect_target", ctes=("hdr",), sql=f"""
SELECT dataset_id, pos, header FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY pos) AS rk FROM hdr WHERE clean IN {TARGETS}) WHERE rk = 1""")
def detect_target(spark, base):
    return MT.detect_targets(U.upload_headers(spark, base))
