"""The registered queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_codes, near_dup, packing, periodic_runs, piece_sampling, pii, quality, spelling, substring_dedup, token_files, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@cache
def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A public SentencePiece model's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), piece_model(), piece_sampling.Sampling(k=3), decoded=True)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge_quality(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: Fixed values of the query on pages.
URL_RULES = (
    url_filter.UrlRule("com/en/", "block"),
    url_filter.UrlRule("example.com/en/7", "allow"),
    url_filter.UrlRule("net/de/", "allow"),
    url_filter.UrlRule("example.net/de/8", "block"),
    url_filter.UrlRule("org/es/", "block"),
)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad of the pages whose document is labelled: the number in a page's path is its document's."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "^/[a-z]+/([0-9]{1,18})", 1)
    marked = labels.where("quality is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    return pages.select("url", number.try_cast("long").alias("doc_id")).join(marked, "doc_id").select("url", "bad")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: The setting with the key of the surrogates. Where it is unset, a key that all know: for tests only.
SURROGATE_KEY, TEST_KEY = "spark.codeperil.surrogateKey", "corpus-key"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), key=spark.conf.get(SURROGATE_KEY, TEST_KEY)).select("doc_id", "text", "n_entities")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_spans(table(spark, sf_dir, "documents"), substring_dedup.PRODUCTION)


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents"), near_dup.NearDup())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, lexicon, threshold=0.3)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return token_files.read_documents(spark, tokens)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op11_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_codes.identify_languages(docs, language_codes.learn_codes(docs))
    return found.select("doc_id", language_codes.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), periodic_runs.Runs(), edit=periodic_runs.planted)
    return periodic_runs.summarised(found)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spelling.Variants(), edit=spelling.with_slips)


QUERIES = {
    "op1_piece_sampling": op1_piece_sampling,
    "op2_quality_rules": op2_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op3_exact_dedup": op3_exact_dedup,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_minhash_near_dup": op6_minhash_near_dup,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_language_codes": op11_language_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}


def _strength_sql(name: str, rows: str) -> str:
    """A prior's strength at a level of op4: rows with n, bad and their parent's mean m."""
    return f"""{name} AS (
            SELECT CASE WHEN k < 2 THEN 1 WHEN v <= e OR more <= 0 THEN 1000 ELSE least(greatest(more / (v - e) - 1, 1), 1000) END AS {name}
            FROM (SELECT count(*) AS k, sum(n * pow(bad / n - m, 2)) AS v, sum(m * (1 - m)) AS e, sum(m * (1 - m) * (n - 1)) AS more FROM {rows} WHERE n > 0))"""


ORACLE: dict[str, str] = {
    "op3_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM n
    """,
    "op4_url_filter": f"""
        WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
        h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
        marked AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        lab AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM h JOIN marked ON doc_id = TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT) GROUP BY host),
        c AS (SELECT host, CAST(coalesce(n, 0) AS DOUBLE) AS n, CAST(coalesce(bad, 0) AS DOUBLE) AS bad, 
                     CASE WHEN address THEN '' WHEN two THEN regexp_extract(own, '[^.]*[.][^.]*$') ELSE regexp_extract(own, '[^.]*$') END AS suffix,
                     CASE WHEN address THEN own WHEN two THEN regexp_extract(own, '([^.]*[.])?[^.]*[.][^.]*$') ELSE regexp_extract(own, '([^.]*[.])?[^.]*$') END AS domain
              FROM (SELECT *, regexp_matches(own, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|\\[.*\\])$') AS address, regexp_matches(own, '(^|[.])(ac|co|com|edu|go|gob|gov|mil|ne|net|or|org)[.][a-z]{{2}}$') AS two
                    FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '[.]+$', '') AS own FROM h)) LEFT JOIN lab USING (host)),
        d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY suffix, domain),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
        w AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS base FROM s),
        {_strength_sql("z1", "(SELECT n, bad, base AS m FROM s, w)")},
        sm AS (SELECT suffix, (bad + z1 * base) / (n + z1) AS m FROM s, w, z1),
        {_strength_sql("z2", "d JOIN sm USING (suffix)")},
        dm AS (SELECT d.suffix, domain, (d.bad + z2 * m) / (d.n + z2) AS m FROM d JOIN sm USING (suffix), z2),
        {_strength_sql("z3", "c JOIN dm USING (suffix, domain)")},
        hm AS (SELECT host, n, z3, (bad + z3 * m) / (n + z3) AS m FROM c JOIN dm USING (suffix, domain), z3),
        rules(rule, own, prefix, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
            ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
        fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM h JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, prefix) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN greatest(0, m - 1.645 * sqrt(m * (1 - m) / (n + z3 + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM h JOIN hm USING (host) LEFT JOIN fit USING (page_id)
    """,
}
