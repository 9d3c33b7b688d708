"""The operators as registered queries over whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from presslens.llm import crf, licences, merkle, mixing, neardup, packing, quality, ranked, rules, toxicity, urls, wavelet, whitening
from presslens.llm.common import fold

# Url rules and their verdicts; words that mark a host as spam.
URL_RULES = urls.Rules({"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"})
SPAM_WORDS = ("spam", "pills", "casino", "viagra", "farm", "cheap")
TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_definition(path: str | None = None) -> str:
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return f.read()


def near_duplicates(spark, sf):
    found = neardup.near_duplicates(table(spark, sf, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def quality_scores(spark, sf):
    docs = table(spark, sf, "documents")
    learnable = table(spark, sf, "labels").where(fold("doc_id", 5) != 0)
    model = quality.fit(docs, learnable)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    found = rules.judged(rules.ordered_rules(docs), F.col("text"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def personal_data(spark, sf):
    docs = table(spark, sf, "documents")
    field = crf.train(crf.labelled_table(spark))
    found = docs.select("doc_id", crf.find_spans(field, F.col("text")).alias("s")).select("doc_id", "s.*")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["finish"].cast("string"))), ",")

    def of_kind(kind):
        return lambda s: s["kind"] == kind

    both = F.flatten(F.array(*[F.filter(c, of_kind(k)) for k in crf.KINDS for c in ("base", "added")]))
    place = {k: n for n, k in enumerate(crf.KINDS)}
    order = F.array_sort(both, lambda x, y: F.when(_rank(x, place) < _rank(y, place), -1).when(_rank(x, place) > _rank(y, place), 1).otherwise(
        F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0)))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in crf.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(order).alias("spans"))


def _rank(span, place):
    return F.coalesce(*[F.when(span["kind"] == k, n) for k, n in place.items()])


def url_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    judged = urls.judge(pages, URL_RULES, urls.spam_hosts(pages, SPAM_WORDS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def licence_scan(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", licences.licence_scan(F.col("text")).alias("found")).select("doc_id", "found.*")


def packed(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer_definition(), window=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def toxicity_scores(spark, sf):
    docs = table(spark, sf, "documents")
    pool = fold("doc_id", 3) != 1
    model = toxicity.fit(docs, table(spark, sf, "labels").where(pool), pool)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def fingerprints(spark, sf):
    return merkle.compared(table(spark, sf, "documents"))


def source_mix(spark, sf):
    mix = mixing.mixture(table(spark, sf, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def ranked_search(spark, sf):
    return ranked.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


def token_files(spark, sf):
    return wavelet.stored_documents(table(spark, sf, "documents"), tokenizer_definition(public_tokenizers.path(WORD_TOKENIZER)))


def whitened_vectors(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"), wanted=32)


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "op1_near_duplicates": near_duplicates,
    "op2_quality_scores": quality_scores,
    "op3_quality_rules": quality_rules,
    "op4_personal_data": personal_data,
    "op5_url_filter": url_filter,
    "op6_licence_scan": licence_scan,
    "op7_packing": packed,
    "op8_toxicity_scores": toxicity_scores,
    "op9_fingerprints": fingerprints,
    "op10_source_mix": source_mix,
    "op11_ranked_search": ranked_search,
    "op12_token_files": token_files,
    "op13_whitening": whitened_vectors,
    "pipeline": pipeline,
}

ORACLE = {
    "op3_quality_rules": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
        counts AS (SELECT r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
            len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM split),
        windows AS (SELECT r, i, words[i : i + 4] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM split)),
        twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 5) AS t(k) GROUP BY r),
        based AS (SELECT c.*, coalesce(v.n_repeat_words, 0) AS n_repeat_words,
            n_words < 10 OR 100 * coalesce(v.n_repeat_words, 0) > 20 * n_words AS base_failed FROM counts c LEFT JOIN covered v USING (r))
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
            n_repeat_words::BIGINT AS n_repeat_words, base_failed,
            NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
                OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) OR 100 * n_capitals > 40 * word_chars) AS kept
        FROM based""",
    "op5_url_filter": r"""
        WITH parts AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        hosts AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
        ruled AS (SELECT page_id, host, path, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM hosts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, '(^|[.-])(spam|pills|casino|viagra|farm|cheap)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op10_source_mix": r"""
        WITH docs AS (SELECT doc_id, source, sha256(concat_ws(chr(31), '11', coalesce(doc_id::VARCHAR, ''))) AS turn, md5(coalesce(text, '')) AS tie,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM docs GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / w, source NULLS LAST) AS k FROM sources),
        sums AS (SELECT *, 1.5::DOUBLE * sum(n) OVER () AS total, coalesce(sum(2 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
            sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM ranked),
        first_free AS (SELECT min(k) AS k FROM sums WHERE (total - capped) * w / free <= 2.0 * n),
        goal AS (SELECT s.source, s.n AS source_size, CASE WHEN s.k < f.k THEN 2.0::DOUBLE * s.n ELSE (g.total - g.capped)::DOUBLE * s.w::DOUBLE / g.free::DOUBLE END AS target
            FROM sums s, first_free f JOIN sums g ON g.k = f.k),
        placed AS (SELECT d.*, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS given,
            coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target, CASE WHEN source_size = 0 THEN 0
            ELSE given // source_size * size + greatest(0, least(size, given % source_size - before)) END::BIGINT AS taken FROM placed""",
    "op11_ranked_search": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        docs AS (SELECT r, doc_id, words, len(words)::BIGINT AS n FROM texts WHERE len(words) > 0),
        totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
        counts AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM docs) GROUP BY ALL),
        items AS (SELECT q, item_id, unnest(list_distinct(words)) AS term FROM (SELECT row_number() OVER () AS q, item_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark)),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, n_docs),
        scored AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM items JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY q, item_id, r, doc_id),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ordered WHERE rank <= 10""",
}
