"""Header matching: which feature a column is, and which industry a table belongs to.

The input is a table ``(dataset_id, pos, header)`` holding the columns of any number of
uploads.  Similarity is exact name (1.0), known synonym (0.95), else the cosine of character
2-4-gram TF-IDF vectors whose corpus is the lexicon plus the upload's own headers.  The
cosine is a join on shared n-grams; the lexicon tables have a fixed size and are broadcast,
and headers are shuffled once, by upload, before their n-grams are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.scalars import char_ngrams, clean_name, stable_round
from tidemark.session import materialize, spread

#: Headers that a task holds on average, and those of one upload that a task may hold.
TASK_HEADERS = 10_000
WIDE = 4_096


def with_clean(headers: DataFrame) -> DataFrame:
    return headers.withColumn("clean", clean_name(F.col("header")))


def is_id(clean: Column) -> Column:
    return clean.isin(*catalog.id_words())


def is_target(clean: Column) -> Column:
    return clean.isin(*catalog.target_words())


def synonym_matches(headers: DataFrame) -> DataFrame:
    """(dataset_id, pos, header, feature) for headers that are a known alias."""
    spark = headers.sparkSession
    aliases = catalog.synonyms(spark).select("feature", "alias_clean").distinct()
    return with_clean(headers).join(
        F.broadcast(aliases), F.col("clean") == F.col("alias_clean")
    ).select("dataset_id", "pos", "header", "feature")


def by_upload(headers: DataFrame) -> list[tuple[DataFrame, bool]]:
    """The headers with their upload's number of them (``n_headers``), dealt out by upload, and whether they are not.

    A task holds whole uploads, so whatever is grouped by upload needs no further shuffle.  Uploads wider than ``WIDE``
    come apart, dealt out by header and marked: their groups are summed by joins, so that none is one task's.
    """
    known = headers.where(F.col("dataset_id").isNotNull())
    counts = known.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_headers"))
    row = counts.agg(F.sum("n_headers").alias("rows"), F.max("n_headers").alias("widest")).first()
    least = -(-(row["rows"] or 0) // TASK_HEADERS)
    if (row["widest"] or 0) <= WIDE:
        return [(_total(spread(known, "dataset_id", least=least), ["dataset_id"], F.count(F.lit(1)), "n_headers", False), False)]
    sized = known.join(counts, "dataset_id")
    wide = F.col("n_headers") > WIDE
    return [(spread(sized.where(~wide), "dataset_id", least=least), False),
            (spread(sized.where(wide), "dataset_id", "pos", least=least), True)]


def _total(df: DataFrame, keys: list[str], total: Column, name: str, wide: bool) -> DataFrame:
    """Every row with the total of its group: within the task that holds its upload, or by a join if none does.

    Size estimates ignore what exploding adds, so the planner might broadcast the groups of all uploads; the hint keeps
    the join shuffled whatever the estimate.
    """
    if not wide:
        return df.withColumn(name, total.over(Window.partitionBy(*keys)))
    sums = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(total.alias(name)).hint("merge")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(sums, same).drop(*[f"__{k}" for k in keys])


def similarities(headers: DataFrame, corpora: tuple[str, ...]) -> DataFrame:
    """(dataset_id, pos, feature, similarity, method) for every related pair.

    ``headers`` carries ``clean``, ``corpus`` (``detect`` or the upload's industry, one per
    upload) and ``wanted``: every row shapes the document frequencies, wanted rows are
    matched.  Features outside the corpus' schemas do not appear.
    """
    parts = [_similarities(rows, corpora, wide) for rows, wide in by_upload(headers)]
    return reduce(DataFrame.unionByName, parts)


def _similarities(headers: DataFrame, corpora: tuple[str, ...], wide: bool) -> DataFrame:
    spark = headers.sparkSession
    sizes = F.create_map(*[x for c in corpora for x in (F.lit(c), F.lit(len(catalog.corpus_documents(c))))])
    entry = "array<struct<feature:string,tf_f:double,ladder:double>>"
    none = F.lit(None).cast("double")
    ladder = F.broadcast(catalog.name_ladder(spark).groupBy("alias_clean").agg(
        F.collect_list(F.struct("feature", none.alias("tf_f"), "ladder")).alias("named")))
    # only features of the upload's own corpus are expanded: 21 of an industry, not all 75
    in_features = catalog.feature_gram_table(spark, corpora).groupBy("corpus", "gram").agg(
        F.collect_list(F.struct("feature", "tf_f", none.alias("ladder"))).alias("in_features"))
    lex = F.broadcast(catalog.corpus_gram_table(spark, corpora).join(in_features, ["corpus", "gram"], "left"))
    norms = F.broadcast(catalog.feature_norm_table(spark, corpora))

    def idf(df: Column) -> Column:
        return F.col("a") - F.log(1.0 + df) + 1.0

    # One row per distinct gram of a header, and one without a gram that carries its names.
    once = F.transform("d", lambda x: F.struct(x.alias("gram"), F.lit(1.0).alias("tf")))
    often = F.transform("d", lambda x: F.struct(x.alias("gram"), F.size(F.filter("g", lambda y: y == x)).cast("double").alias("tf")))
    names = F.array(F.struct(F.lit("").alias("gram"), F.lit(0.0).alias("tf")))
    grams = (
        headers.withColumn("a", F.log(1.0 + sizes[F.col("corpus")] + F.col("n_headers")))
        .join(ladder, F.col("clean") == F.col("alias_clean"), "left")
        .withColumn("g", F.coalesce(char_ngrams(F.col("clean")), F.array().cast("array<string>")))
        .withColumn("d", F.array_distinct("g"))
        .select("dataset_id", "pos", "corpus", "a", "wanted", "named",
                F.inline(F.concat(F.when(F.size("g") == F.size("d"), once).otherwise(often), names)))
    )
    named = F.when(F.col("wanted"), F.col("named"))
    # Dot products with every feature sharing a gram; the header's own norm rides along under the empty feature name.
    own = F.array(F.struct(F.lit("").alias("feature"), F.lit(0.0).alias("tf_f"), none.alias("ladder")))
    found = F.when(F.col("gram") == "", F.coalesce(named, F.array().cast(entry))).otherwise(
        F.concat(own, F.coalesce("in_features", F.array().cast(entry))))
    known = F.coalesce("df_lex", F.lit(0))
    weights = (
        _total(grams, ["dataset_id", "gram"], F.count(F.lit(1)), "df_d", wide)
        .join(lex, ["corpus", "gram"], "left")
        .withColumns({"used": idf(known + F.col("df_d")), "unused": idf(known)})
        .select("dataset_id", "pos", "corpus", "a", "wanted", "tf", "df_d", (F.col("used") * F.col("used")).alias("w"),
                (F.col("unused") * F.col("unused")).alias("w0"), F.inline(found))
    )
    part = F.col("tf") * F.when(F.col("feature") == "", F.col("tf")).otherwise(F.col("tf_f")) * F.col("w")
    # A gram that the upload uses shifts the norm of its features, once for all headers that have it.
    shift = F.col("tf_f") * F.col("tf_f") * (F.col("w") - F.col("w0")) / F.col("df_d")
    pairs = weights.groupBy("dataset_id", "pos", "corpus", "a", "wanted", "feature").agg(
        F.coalesce(F.sum(part), F.lit(0.0)).alias("s"), F.sum(shift).alias("shift"), F.max("ladder").alias("ladder"))
    pairs = _total(pairs, ["dataset_id", "feature"], F.sum("shift"), "adjust", wide).where("wanted").drop("wanted")
    pairs = _total(pairs, ["dataset_id", "pos"], F.max(F.when(F.col("feature") == "", F.col("s"))), "h2", wide)
    a = F.col("a")
    feature_norm = a * a * F.col("s0") + 2 * a * F.col("s1") + F.col("s2") + F.coalesce("adjust", F.lit(0.0))
    cosine = F.coalesce(F.col("s") / F.sqrt(F.col("h2") * feature_norm), F.lit(0.0))
    return pairs.where("feature <> ''").join(norms, ["corpus", "feature"]).select(
        "dataset_id", "pos", "feature",
        stable_round(F.coalesce("ladder", cosine), 9).alias("similarity"),
        F.when(F.col("ladder") == catalog.EXACT_SIMILARITY, "exact")
        .when(F.col("ladder").isNotNull(), "synonym").otherwise("ngram").alias("method"),
    )


def detection_headers(headers: DataFrame) -> DataFrame:
    """Headers that take part in industry detection: neither identifiers nor targets."""
    h = with_clean(headers)
    return h.where(~is_id(F.col("clean")) & ~is_target(F.col("clean"))).withColumns(
        {"corpus": F.lit("detect"), "wanted": F.lit(True)})


def best_matches(headers: DataFrame) -> DataFrame:
    """(dataset_id, pos, industry, feature, similarity): best feature per header and industry.

    The earlier schema column wins a tie.
    """
    spark = headers.sparkSession
    sims = similarities(detection_headers(headers), ("detect",))
    schema = F.broadcast(catalog.feature_catalog(spark).select(
        "industry", "feature", F.col("pos").alias("schema_pos")))
    order = F.struct("similarity", -F.col("schema_pos"))
    return sims.where("similarity > 0").join(schema, "feature").groupBy("dataset_id", "pos", "industry").agg(
        F.max_by("feature", order).alias("feature"), F.max("similarity").alias("similarity"))


def signature_hits(headers: DataFrame) -> DataFrame:
    """(dataset_id, industry, hits): signature fragments inside the headers, every hit counts."""
    h = detection_headers(headers)

    def hits(industry: str) -> Column:
        found = [F.col("clean").contains(t).cast("int") for t in catalog.signature_tokens(industry)]
        total = found[0]
        for f in found[1:]:
            total = total + f
        return F.sum(total).alias("hits")

    wide = h.groupBy("dataset_id").agg(F.array(*[
        F.struct(F.lit(i).alias("industry"), hits(i)) for i in catalog.INDUSTRIES]).alias("per"))
    return wide.select("dataset_id", F.inline("per"))


def industry_scores(headers: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(dataset_id, industry, matched, total_similarity, hits, score)."""
    best = best_matches(headers) if matches is None else matches
    good = F.col("similarity") > catalog.DETECT_THRESHOLD
    sums = best.groupBy("dataset_id", "industry").agg(
        F.count(F.when(good, 1)).alias("matched"),
        F.coalesce(F.sum(F.when(good, F.col("similarity"))), F.lit(0.0)).alias("total_similarity"))
    joined = signature_hits(headers).join(sums, ["dataset_id", "industry"], "left").withColumns({
        "matched": F.coalesce("matched", F.lit(0).cast("bigint")),
        "total_similarity": F.coalesce("total_similarity", F.lit(0.0))})
    width = len(catalog.SCHEMAS[catalog.FALLBACK_INDUSTRY])
    score = F.col("total_similarity") * F.col("matched") / width + F.col("hits") * catalog.SIGNATURE_WEIGHT
    return joined.withColumn("score", stable_round(score, 9))


def detect_industries(headers: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(dataset_id, industry, score); the fallback when nothing matches."""
    scores = industry_scores(headers) if scores is None else scores
    pos = F.element_at(F.create_map(*[x for i, n in enumerate(catalog.INDUSTRIES) for x in (F.lit(n), F.lit(i))]),
                       F.col("industry"))
    top = scores.groupBy("dataset_id").agg(
        F.max_by("industry", F.struct(F.col("score"), -pos)).alias("top"), F.max("score").alias("score"))
    enough = F.col("score") >= catalog.MIN_INDUSTRY_SCORE
    return headers.select("dataset_id").distinct().join(top, "dataset_id", "left").select(
        "dataset_id",
        F.when(enough, F.col("top")).otherwise(F.lit(catalog.FALLBACK_INDUSTRY)).alias("industry"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def match_details(headers: DataFrame, n: int = 5, matches: DataFrame | None = None) -> DataFrame:
    """(dataset_id, industry, rank, matched, total_similarity, score, details): all industries, the best first.

    The score is the similarity of the accepted matches times the share of the schema they cover; ``details`` are the
    first ``n`` of them in header order (header, feature, similarity).  Rows beyond those are cut off before anything is
    collected, so a wide upload never makes a long list.
    """
    spark = headers.sparkSession
    best = materialize((best_matches(headers) if matches is None else matches).where(
        F.col("similarity") > catalog.DETECT_THRESHOLD), "best-matches")
    first = best.withColumn("place", F.row_number().over(Window.partitionBy("dataset_id", "industry").orderBy("pos"))).where(
        F.col("place") <= n)
    shown = first.join(headers.select("dataset_id", "pos", "header"), ["dataset_id", "pos"]).groupBy("dataset_id", "industry").agg(
        F.sort_array(F.collect_list(F.struct("place", "header", "feature", stable_round(F.col("similarity"), 3).alias("similarity")))).alias("details"))
    sums = best.groupBy("dataset_id", "industry").agg(F.count(F.lit(1)).alias("matched"), F.sum("similarity").alias("total_similarity"))
    listed = F.array(*[F.struct(F.lit(i).alias("industry"), F.lit(k).alias("industry_pos")) for k, i in enumerate(catalog.INDUSTRIES)])
    width = F.create_map(*[x for i in catalog.INDUSTRIES for x in (F.lit(i), F.lit(len(catalog.SCHEMAS[i])))])
    every = headers.select("dataset_id").distinct().select("dataset_id", F.inline(listed))
    rows = every.join(sums, ["dataset_id", "industry"], "left").join(shown, ["dataset_id", "industry"], "left").withColumns({
        "matched": F.coalesce("matched", F.lit(0).cast("bigint")), "total_similarity": F.coalesce("total_similarity", F.lit(0.0)),
        "details": F.transform(F.coalesce("details", F.expr("array()").cast(shown.schema["details"].dataType)),
                               lambda d: d.dropFields("place"))})
    rows = rows.withColumn("score", stable_round(F.col("total_similarity") * F.col("matched") / width[F.col("industry")], 9))
    rank = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("score"), "industry_pos"))
    return rows.select("dataset_id", "industry", rank.alias("rank"), "matched", "total_similarity", "score", "details")


def column_mapping(headers: DataFrame, industries: DataFrame) -> DataFrame:
    """(dataset_id, pos, header, feature, similarity, method) of the accepted matches.

    Identifier headers map to ``customer_id`` (a true id before row numbers and surnames).
    Every other header goes to its best feature if that reaches the threshold; of several
    headers with the same best feature an exact name wins, then the first one, and the
    others stay unmapped.
    """
    # One row per upload, used twice below: written so that detection runs once.
    industries = materialize(industries.select("dataset_id", "industry"), "industries")
    h = with_clean(headers).join(industries.select("dataset_id", F.col("industry").alias("corpus")), "dataset_id")
    h = h.withColumn("wanted", ~is_id(F.col("clean")))
    spark = headers.sparkSession
    sims = similarities(h, catalog.INDUSTRIES)
    schema = catalog.feature_catalog(spark).select("feature", F.col("pos").alias("schema_pos"), "industry")
    corpus = industries.select("dataset_id", "industry")
    ranked = sims.join(corpus, "dataset_id").join(F.broadcast(schema), ["industry", "feature"])
    order = F.struct("similarity", -F.col("schema_pos"))
    best = ranked.groupBy("dataset_id", "pos").agg(
        F.max_by("feature", order).alias("feature"), F.max("similarity").alias("similarity"),
        F.max_by("method", order).alias("method"))
    best = best.where(F.col("similarity") > catalog.MAP_THRESHOLD).withColumn(
        "turn", F.struct((F.col("method") != "exact").cast("int").alias("late"), F.col("pos").alias("pos")))
    ids = h.where(~F.col("wanted")).select(
        "dataset_id", "pos", F.lit("customer_id").alias("feature"), F.lit(1.0).alias("similarity"),
        F.lit("id").alias("method"),
        F.struct((~F.col("clean").isin(*catalog.true_id_words())).cast("int").alias("late"),
                 F.col("pos").alias("pos")).alias("turn"))
    winners = best.unionByName(ids).groupBy("dataset_id", "feature").agg(
        F.min("turn").alias("turn"), F.min_by("similarity", "turn").alias("similarity"),
        F.min_by("method", "turn").alias("method"))
    return winners.select("dataset_id", F.col("turn.pos").alias("pos"), "feature", "similarity", "method").join(
        headers, ["dataset_id", "pos"])


def detect_targets(headers: DataFrame) -> DataFrame:
    """(dataset_id, pos, header): the first header that names the churn label."""
    h = with_clean(headers).where(is_target(F.col("clean")))
    return h.groupBy("dataset_id").agg(F.min(F.struct("pos", "header")).alias("t")).select("dataset_id", "t.*")


# ---------------------------------------------------------------------------
# One table at a time
# ---------------------------------------------------------------------------
def header_frame(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "dataset_id bigint, pos int, header string")


# Both functions depend on the header list alone, and uploads tend to repeat their layout.
_KNOWN_LAYOUTS: dict[tuple, object] = {}
_MAX_LAYOUTS = 1_000


def _remember(key: tuple, value: object) -> object:
    if len(_KNOWN_LAYOUTS) >= _MAX_LAYOUTS:
        _KNOWN_LAYOUTS.clear()
    _KNOWN_LAYOUTS[key] = value
    return value


def detect_industry(spark, names: list[str]) -> str:
    key = ("detect", *names)
    if key not in _KNOWN_LAYOUTS:
        _remember(key, detect_industries(header_frame(spark, names)).first()["industry"])
    return _KNOWN_LAYOUTS[key]


def map_columns(spark, names: list[str], industry: str) -> dict[str, str]:
    """{header: feature} for one table; a table's width bounds the result."""
    key = ("map", industry, *names)
    if key not in _KNOWN_LAYOUTS:
        fixed = spark.createDataFrame([(0, industry)], "dataset_id bigint, industry string")
        rows = column_mapping(header_frame(spark, names), fixed).orderBy("pos").collect()
        _remember(key, {r["header"]: r["feature"] for r in rows})
    return dict(_KNOWN_LAYOUTS[key])


def similarity_score(spark, left: str, right: str, names: list[str] | None = None) -> float:
    """Similarity of a header and a feature within the detection corpus of ``names``."""
    names = list(dict.fromkeys([left, *(names or [])]))
    h = with_clean(header_frame(spark, names)).withColumns(
        {"corpus": F.lit("detect"), "wanted": F.col("pos") == 0})
    row = similarities(h, ("detect",)).where(F.col("feature") == right).first()
    return row["similarity"] if row else 0.0


def tfidf(headers: DataFrame) -> DataFrame:
    """(dataset_id, pos, gram, weight): smoothed, L2-normalised TF-IDF with one corpus per upload."""
    return reduce(DataFrame.unionByName, [_tfidf(rows, wide) for rows, wide in by_upload(headers)])


def _tfidf(headers: DataFrame, wide: bool) -> DataFrame:
    grams = headers.select("dataset_id", "pos", "n_headers", F.explode(char_ngrams(F.col("clean"))).alias("gram"))
    tf = grams.groupBy("dataset_id", "pos", "gram", "n_headers").agg(F.count(F.lit(1)).alias("tf"))
    x = F.col("tf") * (F.log((1.0 + F.col("n_headers")) / (1.0 + F.col("df"))) + 1.0)
    weighted = _total(tf, ["dataset_id", "gram"], F.count(F.lit(1)), "df", wide).withColumn("x", x)
    normed = _total(weighted, ["dataset_id", "pos"], F.sum(F.col("x") * F.col("x")), "squares", wide)
    return normed.select("dataset_id", "pos", "gram", (F.col("x") / F.sqrt("squares")).alias("weight"))
