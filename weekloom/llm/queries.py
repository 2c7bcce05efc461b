"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import (
    compression, decontamination, extraction, jaccard, licences, lines, mixing, negatives, quality, search, sharding, shipped,
    suffix_array, suffix_tree)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf}/{name}.parquet")


def op1_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffix_array.without_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf, "documents"))


def mix_weights() -> dict[str, Column]:
    """Target weights of the registered mixture: domains 3 : 2 : 1, English twice any other."""
    return {
        "domain": F.when(F.col("domain") == "d0", 3).when(F.col("domain") == "d1", 2).otherwise(1),
        "lang": F.when(F.col("lang") == "en", 2).otherwise(1)}


def source_domain() -> Column:
    """Three domains, by the last character of the source's name."""
    return F.concat(F.lit("d"), (F.ascii(F.right(F.col("source"), F.lit(1))) % 3).cast("string"))


def op4_source_mixture(spark: SparkSession, sf: str) -> DataFrame:
    chosen = mixing.mixture(table(spark, sf, "documents"), mix_weights(), domain=source_domain())
    return mixing.repeated(chosen.drop("tag"), "copies")


def op5_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf, "documents"))


def op7_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


def op8_benchmark_contamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_suffix_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return suffix_tree.suffix_tree_scores(table(spark, sf, "documents"), held_out)


def op10_fuzzy_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf, "documents"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    relabelled = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, relabelled=relabelled)


def op12_dual_tree_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = compression.compressed(table(spark, sf, "embeddings"))
    return compression.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.main_text(table(spark, sf, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_subword_quality, op2_suffix_array_dedup, op3_licence_scan, op4_source_mixture, op5_hilbert_shards, op6_ngram_jaccard, op7_exact_top_k, op8_benchmark_contamination,
    op9_suffix_tree_scores, op10_fuzzy_line_dedup, op11_hard_negatives, op12_dual_tree_codes, op13_main_text)}

# Words of the benchmark contract; ASCII letters alone are lower-cased.
_ALNUM_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

# Words between ASCII white space; ASCII letters alone are lower-cased.
_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')")

def _split_sql(source: str, parent: str, name: str) -> str:
    """Part of the parent's budget for each child, as the operator splits it."""
    by = f"PARTITION BY {parent}" if parent else ""
    part = f"PARTITION BY {parent}, full_" if parent else "PARTITION BY full_"
    return f"""
      SELECT * REPLACE (CASE WHEN NOT full_ AND place <= odd THEN part + 1 ELSE part END AS part) FROM (
        SELECT *, left_ - sum(CASE WHEN NOT full_ THEN part END) OVER ({by}) AS odd,
          row_number() OVER ({part} ORDER BY ratio, {name}) AS place FROM (
          SELECT *, CASE WHEN full_ THEN capacity ELSE ((weight * left_) // open_)::BIGINT END AS part FROM (
            SELECT *, budget - coalesce(sum(CASE WHEN full_ THEN capacity END) OVER ({by}), 0) AS left_,
              sum(CASE WHEN NOT full_ THEN weight END) OVER ({by}) AS open_ FROM (
              SELECT *, capacity * rest_ <= weight * (budget - before) AS full_ FROM (
                SELECT *, capacity / weight AS ratio,
                  coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(weight) OVER ({by} ORDER BY capacity / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_
                FROM ({source}))))))"""


def mixture_sql(docs: str) -> str:
    """Common table expressions that end in ``taken`` (doc_id, domain, lang, source, n_tokens, budget, epochs)."""
    token = r"[^\x20\x09-\x0D]+"
    domain = "'d' || (ascii(right(source, 1)) % 3)::VARCHAR"
    domains = _split_sql("""
      SELECT domain, sum(2 * supply)::HUGEINT AS capacity, CASE domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 2 ELSE 1 END::HUGEINT AS weight,
        (SELECT sum(supply) FROM leaves)::HUGEINT AS budget FROM leaves GROUP BY domain""", "", "domain")
    langs = _split_sql("""
      SELECT l.domain, lang, sum(2 * supply)::HUGEINT AS capacity, CASE lang WHEN 'en' THEN 2 ELSE 1 END::HUGEINT AS weight,
        any_value(d.part)::HUGEINT AS budget FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, lang""", "domain", "lang")
    sources = _split_sql("""
      SELECT l.domain, l.lang, source, supply, (2 * supply)::HUGEINT AS capacity, 1::HUGEINT AS weight, d.part::HUGEINT AS budget
      FROM leaves l JOIN langs d USING (domain, lang)""", "domain, lang", "source")
    return f"""
    mix_rows AS (
      SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name, coalesce({domain}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        len(regexp_extract_all(coalesce(text, ''), '{token}'))::BIGINT AS n_tokens FROM {docs}),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM mix_rows GROUP BY ALL),
    domains AS ({domains}),
    langs AS ({langs}),
    sources AS ({sources}),
    budgets AS (
      SELECT domain, lang, source, part::BIGINT AS budget, CASE WHEN supply > 0 THEN (part // supply)::BIGINT ELSE 0 END AS passes,
        CASE WHEN supply > 0 THEN (part % supply)::BIGINT ELSE 0 END AS rest FROM sources),
    placed AS (
      SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-' || passes || '-' || name), doc_id, n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM mix_rows JOIN budgets USING (domain, lang, source)),
    taken AS (SELECT *, passes + CASE WHEN before < rest THEN 1 ELSE 0 END AS epochs FROM placed)"""


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Vectors, codebooks of every round (b0 to b4) and the last assignment (near)."""
    step = f"(len(w) // {parts})"
    steps = [f"""
    WITH v AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings WHERE {_USABLE}),
    parts AS MATERIALIZED (SELECT vec_id, p, w[p * {step} + 1:(p + 1) * {step}] AS w FROM v, (SELECT unnest(range({parts})) AS p)),
    b0 AS MATERIALIZED (
      SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM parts
      WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    near = """(
      SELECT vec_id, p, w, n.e AS e, n.d AS d FROM (
        SELECT x.vec_id, x.p, any_value(x.w) AS w,
          min(struct_pack(d := list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.e)) AS n
        FROM parts x JOIN {book} b ON x.p = b.p GROUP BY x.vec_id, x.p))"""
    for r in range(rounds):
        steps.append(f"""
    near{r} AS MATERIALIZED {near.format(book=f"b{r}")},
    mean{r} AS MATERIALIZED (
      SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS w FROM (
        SELECT p, e, i, sum(x)::DOUBLE AS s, count(*) AS n FROM (
          SELECT p, e, unnest(w) AS x, unnest(range(len(w))) AS i FROM near{r}) GROUP BY p, e, i) GROUP BY p, e),
    b{r + 1} AS MATERIALIZED (
      SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)""")
    return ",".join([*steps, f"\n    near AS MATERIALIZED {near.format(book=f'b{rounds}')}"])


def _article_sql(html: str) -> str:
    """The lines of the article element: no comments, tags or references, white space squeezed."""
    inner = rf"regexp_extract({html}, '<article>(.*)</article>', 1, 's')"
    for old, new in ((r"\s+", " "), (r"</?(p|h1)>", chr(10)), (r"<[^>]*>", ""), (r"&lt;?", "<"), (r"&gt;?", ">"), (r"&quot;?", chr(34)),
                     (r"&#x27;", "''"), (r"&amp;?", "&"), (r" *\n *", chr(10)), (r"\n+", chr(10)), (r"  +", " ")):
        inner = f"regexp_replace({inner}, '{old}', '{new}', 'g')"
    return f"trim({inner}, ' ' || chr(10))"


ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS t FROM (
      SELECT doc_id, h, unnest(range(len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
    often AS (SELECT t FROM s GROUP BY t HAVING count(*) > 1),
    hit AS (SELECT doc_id, i FROM s WHERE t IN (SELECT t FROM often)),
    cut AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hit),
    run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM cut),
    span AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY ALL),
    gaps AS (
      SELECT doc_id, r, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY r), 0) AS before FROM span),
    kept AS (
      SELECT g.doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY r) AS k
      FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
    SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_source_mixture": f"""
    WITH {mixture_sql("documents")}
    SELECT doc_id, domain, lang, source, unnest(range(epochs))::INT AS epoch, n_tokens, budget AS leaf_tokens FROM taken""",
    "op6_ngram_jaccard": f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(doc_id, r) AS (
      SELECT DISTINCT a, a FROM both_ways UNION SELECT b, r FROM reach JOIN both_ways ON a = reach.doc_id),
    c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op7_exact_top_k": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    ranked AS (
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
    SELECT * FROM ranked WHERE rank <= 10""",
    "op8_benchmark_contamination": f"""
    WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
    spans AS (
      SELECT item_id, least(len(w), 10) AS n, unnest(CASE WHEN len(w) > 0 THEN range(1, greatest(len(w) - 9, 1) + 1) ELSE [] END) AS i, w FROM b),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM spans),
    sizes AS (SELECT DISTINCT n FROM windows),
    places AS (
      SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN sizes ON len(w) >= n),
    found AS (
      SELECT p.doc_id, p.n, p.p, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.t = array_to_string(p.w[p.p:p.p + p.n - 1], ' ')),
    hit AS (SELECT doc_id, count(DISTINCT h)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS h FROM found) GROUP BY doc_id),
    held AS (
      SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h
      FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""",
    "op11_hard_negatives": f"""
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
      FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
    pairs AS MATERIALIZED (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        list_sum(list_transform(list_zip(a.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5""",
    "op12_dual_tree_codes": f"""{_lloyd_sql()},
    coded AS (
      SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near GROUP BY vec_id),
    digest AS (
      SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
        SELECT p, e, unnest(w) AS x, unnest(range(len(w))) AS i FROM b4))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN v USING (vec_id), digest""",
    "op13_main_text": f"""
    SELECT page_id, url, {_article_sql("coalesce(html, '')")} AS text, len(text)::BIGINT AS n_chars FROM pages""",
}
