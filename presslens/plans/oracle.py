"""The same results as ``queries`` in DuckDB SQL, one statement per key."""

from __future__ import annotations

from presslens.functions.text import STOP_SUBSTRINGS
from presslens.plans.queries import DIM, HANGUL, LATIN

WS = r"[\t\n\x0B\f\r ]"
ANY_WS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{ANY_WS}+|{ANY_WS}+$', '', 'g')"


def clean(x: str) -> str:
    text = rf"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    text = rf"regexp_replace({text}, '[^가-힣a-zA-Z0-9\t\n\x0B\f\r ]', ' ', 'g')"
    text = rf"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"
    for stop in STOP_SUBSTRINGS:
        text = f"replace({text}, '{stop}', '')"
    return text


def words(x: str) -> str:
    return (
        rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{Nl}}\p{{No}}_]+'), "
        "lambda w: length(w) BETWEEN 2 AND 50 AND NOT starts_with(w, '_'))"
    )


def space_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '{ANY_WS}+'), lambda w: w <> '')"


def r6(x: str, name: str = "") -> str:
    return f"round({x}, 6) + CAST(0 AS DOUBLE)" + (f" AS {name}" if name else "")


def reloaded(rows: str, key: str) -> str:
    """A tenth of the rows is scored; nothing is out of range and a saved copy changes nothing."""
    zeros = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("outside", "undecided", "changed"))
    return f"SELECT count(*) AS n_scored, {zeros} FROM {rows} WHERE substr(md5('7:' || {key}), 1, 8) < '19999999'"


ARTICLES = r"""articles AS (
  SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS content
  FROM documents)"""
LABELLED = "labelled AS (SELECT a.*, 1 - l.quality AS label FROM articles a LEFT JOIN labels l ON l.doc_id = a.article_id)"
PREDICTIONS = """predictions AS (
  SELECT doc_id, 1 - quality AS y, prob, CAST(prob >= 0.5 AS INTEGER) AS pred
  FROM (SELECT l.doc_id, l.quality, round(CAST(d.n_chars % 50 AS DOUBLE) / 50, 2) AS prob
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id))"""
HISTORY = """history AS (
  SELECT event_type AS metric, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value
  FROM events WHERE event_type IS NOT NULL)"""


def tfidf(*sides: str) -> str:
    """CTEs ``stacked``, ``tc`` (counts), ``fit`` (kept terms), ``w`` (weights)."""
    stacked = " UNION ALL ".join(f"SELECT article_id, '{s}' AS side, {s} AS text FROM articles" for s in sides)
    return rf"""{ARTICLES},
stacked AS ({stacked}),
tok AS (SELECT article_id, side, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM stacked),
occ AS (SELECT article_id, side, unnest(ws) AS term FROM tok UNION ALL
  SELECT article_id, side, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM tok),
tc AS (SELECT article_id, side, term, count(*) AS tf FROM occ GROUP BY ALL),
top AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tc GROUP BY term ORDER BY cf DESC, term LIMIT 50000),
fit AS (SELECT term, df, cf, ln((1.0 + (SELECT count(*) FROM stacked)) / (1.0 + df)) + 1.0 AS idf FROM top),
w AS (SELECT article_id, side, term, tf * idf AS w FROM tc JOIN fit USING (term))"""


COSINE = tfidf("title", "content") + """,
pair AS (SELECT article_id, sum(CASE side WHEN 'title' THEN w ELSE 0 END) AS t, sum(CASE side WHEN 'content' THEN w ELSE 0 END) AS c
  FROM w GROUP BY article_id, term),
dots AS (SELECT article_id, sum(t * c) AS d, sqrt(sum(t * t)) AS nt, sqrt(sum(c * c)) AS nc FROM pair GROUP BY article_id),
cosines AS (SELECT a.article_id, a.title, coalesce(CASE WHEN nt * nc > 0 THEN d / (nt * nc) END, 0) AS cos_sim
  FROM articles a LEFT JOIN dots USING (article_id))"""
COSINE_LABELLED = COSINE + """,
scored AS (SELECT c.article_id, c.cos_sim, 1 - l.quality AS label FROM cosines c LEFT JOIN labels l ON l.doc_id = c.article_id)"""

FULL = f"full_text AS (SELECT article_id, {words(strip('title || chr(32) || content'))} AS tokens FROM articles)"
COUNTS = "counts AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM full_text) GROUP BY token)"


def vocab(*specials: str) -> str:
    rows = ", ".join(f"('{s}', {i}, 0)" for i, s in enumerate(specials))
    return f"""{ARTICLES}, {FULL}, {COUNTS},
vocab AS (
  SELECT token, CAST(id AS BIGINT) AS id, CAST(cnt AS BIGINT) AS cnt FROM (VALUES {rows}) AS s(token, id, cnt)
  UNION ALL SELECT token, row_number() OVER (ORDER BY cnt DESC, token) + {len(specials) - 1} AS id, cnt FROM counts WHERE cnt >= 2)"""


VOCAB = vocab("<pad>", "<unk>")
VECTORS = VOCAB + """,
wv AS (SELECT v.token, v.id, e.embedding AS vec FROM vocab v JOIN embeddings e ON e.vec_id = v.id - 2),
wd AS (SELECT token, unnest(range(0, len(vec))) AS dim, unnest(vec)::DOUBLE AS x FROM wv)"""
PAIRS = VOCAB + """,
places AS (SELECT article_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM full_text),
near AS (SELECT x.token AS a, y.token AS b, count(*) AS n FROM places x JOIN (SELECT article_id, token, pos - unnest(range(1, 6)) AS pos FROM places) y
  USING (article_id, pos) GROUP BY ALL),
known AS (SELECT a, b, n FROM near WHERE a IN (SELECT token FROM vocab) AND b IN (SELECT token FROM vocab)),
pairs AS (SELECT token, context, sum(n) AS n FROM (SELECT a AS token, b AS context, n FROM known UNION ALL SELECT b, a, n FROM known) GROUP BY ALL)"""
CAPPED = f"""{ARTICLES},
cleaned AS (SELECT article_id, {space_words('lower(' + strip(clean('title') + ' || chr(32) || ' + clean('content')) + ')')} AS tokens FROM articles),
places AS (SELECT article_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM cleaned),
firsts AS (SELECT token, count(*) AS cnt, min(article_id * 10000000 + pos) AS first FROM places GROUP BY token),
vocab AS (SELECT '<OOV>' AS token, CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS cnt UNION ALL
  SELECT token, row_number() OVER (ORDER BY cnt DESC, first) + 1, cnt FROM firsts)"""


def means(sides: str) -> str:
    """Sentence vectors of the named sides as ``sv(article_id, side, dim, v)``, zeros included."""
    texts = " UNION ALL ".join(f"SELECT article_id, '{s}' AS side, {words(s)} AS tokens FROM articles" for s in sides.split())
    return f"""{VECTORS},
texts AS ({texts}),
hits AS (SELECT article_id, side, token, count(*) AS n FROM (SELECT article_id, side, unnest(tokens) AS token FROM texts)
  WHERE token IN (SELECT token FROM wv) GROUP BY ALL),
sums AS (SELECT article_id, side, dim, sum(n * x) / sum(n) AS v FROM hits JOIN wd USING (token) GROUP BY ALL),
sv AS (SELECT t.article_id, t.side, d.dim, coalesce(s.v, 0) AS v FROM texts t
  JOIN (SELECT unnest(range(0, {DIM})) AS dim) d ON true LEFT JOIN sums s ON s.article_id = t.article_id AND s.side = t.side AND s.dim = d.dim)"""


def summary(keys: str) -> str:
    """Group ``x`` by dim into the summary columns."""
    return f"""{keys}, {r6('sum(CASE WHEN dim = 0 THEN v ELSE 0 END)', 'v_first')},
{r6(f'sum(CASE WHEN dim = {DIM - 1} THEN v ELSE 0 END)', 'v_last')}, {r6('sum(v)', 'v_sum')}, {r6('sqrt(sum(v * v))', 'v_norm')}"""


def padded(ids: str, length: int) -> str:
    return f"array_to_string(list_concat({ids}, list_transform(range(0, {length} - len({ids})), lambda i: 0)), ' ')"


def histogram(rows: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    where = f"WHERE {by} IS NOT NULL" if by else ""
    grid = f"(SELECT DISTINCT {by} FROM rows) g JOIN" if by else ""
    match = f"AND c.{by} = g.{by}" if by else ""
    out = f"g.{by}, " if by else ""
    on = "ON true" if by else ""
    return f""", rows AS (SELECT * FROM {rows} {where}),
b AS (SELECT min(cos_sim) AS lo, max(cos_sim) AS hi FROM rows),
c AS (SELECT {keys}CAST(least(floor((cos_sim - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM rows, b GROUP BY ALL)
SELECT {out}CAST(s.bin AS INTEGER) AS bin, {r6('(SELECT lo + (hi - lo) * s.bin / 50 FROM b)', 'bin_start')}, coalesce(c.n, 0) AS n
FROM {grid} (SELECT unnest(range(0, 50)) AS bin) s {on} LEFT JOIN c ON c.bin = s.bin {match}"""


def density(rows: str, cut: float, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    where = f"WHERE {by} IS NOT NULL" if by else ""
    match = f"r.{by} = g.{by}" if by else "true"
    out = f"g.{by}, " if by else ""
    return f""", rows AS (SELECT * FROM {rows} {where}),
s AS (SELECT {keys}count(*) AS n, stddev_samp(cos_sim) * pow(count(*), -0.2) AS h, min(cos_sim) AS lo, max(cos_sim) AS hi FROM rows GROUP BY ALL),
g AS (SELECT {keys}n, h, p.point, lo - {cut} * h + (hi - lo + 2 * {cut} * h) / 199 * p.point AS x
  FROM s, (SELECT unnest(range(0, 200)) AS point) p)
SELECT {out}CAST(g.point AS INTEGER) AS point, {r6('any_value(g.x)', 'x')},
  {r6('sum(exp(-pow((g.x - r.cos_sim) / g.h, 2) / 2)) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi()))', 'density')}
FROM g JOIN rows r ON {match} GROUP BY {out}g.point"""


def respelled(x: str) -> str:
    return rf"""regexp_replace(translate(lower({x}), '{LATIN}', '{HANGUL}'), '[^가-힣0-9 \n,."]', '', 'g')"""


RATES = """cells AS (SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp FROM predictions),
rates AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS acc, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
  coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0, tn + fp AS s0, tp + fn AS s1 FROM cells)"""
AUROC = """per AS (SELECT prob, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM predictions GROUP BY prob),
cum AS (SELECT *, sum(neg) OVER (ORDER BY prob) - neg AS below FROM per),
area AS (SELECT CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) END AS auroc FROM cum)"""
CURVE = """per AS (SELECT prob, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM predictions GROUP BY prob),
cum AS (SELECT prob, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp FROM per),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM per)"""
LOGITS = """logits AS (SELECT l.doc_id, -0.5::DOUBLE + d.n_chars / 1000::DOUBLE * 0.25::DOUBLE + l.toxic * (-0.75)::DOUBLE AS logit1
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
PROB = "1 / (1 + exp(-logit1 - logit1))"
LABEL_ROWS = "label_rows AS (SELECT doc_id, 1 - quality AS label FROM labels)"
GRAMS = "list_distinct(list_concat(" + ", ".join(
    f"list_transform(range(1, length('<' || token || '>') - {n} + 2), lambda i: substr('<' || token || '>', i, {n}))" for n in range(3, 7)
) + "))"

ORACLE = {
    "clean_pages": f"SELECT page_id, {clean('html')} AS clean_text FROM pages",
    "article_text": f"WITH {ARTICLES} SELECT article_id, {strip('title')} AS title, {strip('title || chr(32) || content')} AS text FROM articles",
    "clean_articles": f"""WITH {ARTICLES}, c AS (SELECT article_id, {clean('title')} AS title, {clean('content')} AS content FROM articles)
SELECT article_id, title, {strip('title || chr(32) || content')} AS text FROM c""",
    "normalised_articles": f"WITH {ARTICLES}, {LABELLED} SELECT article_id, title, content, coalesce(label, 0) AS label FROM labelled",
    "unlabelled_articles": f"WITH {ARTICLES} SELECT article_id, CAST(NULL AS INTEGER) AS label FROM articles",
    "head_preview": f"WITH {ARTICLES} SELECT article_id, title FROM articles ORDER BY article_id LIMIT 5",
    "drop_nulls": """SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.doc_id IS NOT NULL AND d.source IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
    "drop_required": f"WITH {ARTICLES}, {LABELLED} SELECT article_id, label FROM labelled WHERE label IS NOT NULL AND title IS NOT NULL AND content IS NOT NULL",
    "label_domain": """SELECT count(*) FILTER (NOT coalesce(l.quality + l.toxic IN (0, 1), false)) AS invalid_labels
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "null_rates": f"WITH {ARTICLES}, {LABELLED} SELECT " + ", ".join(
        r6(f"avg(CAST({c} IS NULL AS INTEGER)) * 100", f"{c}_null_pct") for c in ("title", "content", "label")
    ) + " FROM labelled",
    "table_shape": """SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT unnest(columns) FROM
  (SELECT json_keys(to_json(d)) AS columns FROM (SELECT * FROM documents LIMIT 1) d))) AS n_cols FROM documents""",
    "duplicates": f"WITH {ARTICLES} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM articles GROUP BY title, content)",
    "tfidf_terms": f"WITH {tfidf('title', 'content')} SELECT term, df, cf, {r6('idf', 'idf')} FROM fit",
    "title_content_cosine": f"WITH {COSINE} SELECT article_id, {r6('cos_sim', 'cos_sim')} FROM cosines",
    "cosine_topk": f"WITH {COSINE} SELECT article_id, title, {r6('cos_sim', 'cos_sim')} FROM cosines ORDER BY round(cos_sim, 6) DESC, article_id LIMIT 10",
    "cosine_bottomk": f"WITH {COSINE} SELECT article_id, title, {r6('cos_sim', 'cos_sim')} FROM cosines ORDER BY round(cos_sim, 6), article_id LIMIT 10",
    "cosine_describe": f"WITH {COSINE} SELECT count(*) AS count, " + ", ".join(
        r6(e, n) for e, n in (
            ("avg(cos_sim)", "mean"), ("stddev_samp(cos_sim)", "std"), ("min(cos_sim)", "min"), ("max(cos_sim)", "max"),
            ("quantile_cont(cos_sim, 0.25)", "p25"), ("quantile_cont(cos_sim, 0.5)", "p50"), ("quantile_cont(cos_sim, 0.75)", "p75"),
        )
    ) + " FROM cosines",
    "cosine_hist": f"WITH {COSINE}{histogram('cosines')}",
    "cosine_hist_by_label": f"WITH {COSINE_LABELLED}{histogram('scored', 'label')}",
    "cosine_by_label": f"WITH {COSINE_LABELLED} SELECT label, {r6('avg(cos_sim)', 'mean_cos_sim')} FROM scored WHERE label IS NOT NULL GROUP BY label",
    "cosine_kde": f"WITH {COSINE_LABELLED}{density('scored', 3, 'label')}",
    "cosine_kde_overall": f"WITH {COSINE}{density('cosines', 0)}",
    "centroid_terms": f"""WITH {tfidf('content')}, nrm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY article_id)
SELECT term, {r6('sum(w / n) / (SELECT count(*) FROM articles)', 'mean_weight')} FROM w JOIN nrm USING (article_id) GROUP BY term""",
    "centroid_cosine": f"""WITH {tfidf('content')}, nrm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY article_id),
m AS (SELECT term, sum(w / n) / (SELECT count(*) FROM articles) AS m FROM w JOIN nrm USING (article_id) GROUP BY term),
d AS (SELECT article_id, sum(w * m) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(m * m)) FROM m)) AS c FROM w JOIN m USING (term) GROUP BY article_id)
SELECT a.article_id, {r6('coalesce(d.c, 0)', 'cos_tfidf_mean')} FROM articles a LEFT JOIN d USING (article_id)""",
    "tfidf_norm": f"""WITH {tfidf('content')}, nrm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY article_id)
SELECT a.article_id, {r6('coalesce(n, 0)', 'tfidf_norm')} FROM articles a LEFT JOIN nrm USING (article_id)""",
    "tfidf_weights": f"""WITH {tfidf('content')}, nrm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY article_id)
SELECT article_id, term, {r6('w / n', 'weight')} FROM w JOIN nrm USING (article_id)""",
    "stacked_texts": f"WITH {tfidf('title', 'content')} SELECT side, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM stacked GROUP BY side",
    **{
        key: f"""WITH {ARTICLES}, t AS (SELECT article_id, {tokens("(title || ' ' || content)")} AS tokens FROM articles)
SELECT article_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, '|')) AS digest FROM t"""
        for key, tokens in (("tok_words", words), ("tok_space", space_words))
    },
    "tok_terms": rf"""WITH {ARTICLES}, ws AS MATERIALIZED (SELECT article_id, regexp_extract_all(lower(title || ' ' || content), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM articles),
t AS (SELECT article_id, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS tokens FROM ws)
SELECT article_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, '|')) AS digest FROM t""",
    "token_counts": f"WITH {ARTICLES}, {FULL}, {COUNTS} SELECT token, cnt FROM counts",
    "vocab_freq": f"WITH {VOCAB} SELECT token, id, cnt FROM vocab",
    "vocab_capped": f"WITH {CAPPED} SELECT token, id, cnt FROM vocab",
    "ids_head256": f"""WITH {VOCAB},
short AS (SELECT article_id, list_slice(tokens, 1, 256) AS tokens FROM full_text),
p AS (SELECT article_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM short),
i AS (SELECT article_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM p LEFT JOIN vocab v USING (token) GROUP BY article_id)
SELECT s.article_id, {padded('coalesce(ids, [])', 256)} AS ids FROM short s LEFT JOIN i USING (article_id)""",
    "ids_tail500": f"""WITH {CAPPED},
short AS (SELECT article_id, list_slice(tokens, greatest(len(tokens) - 500, 0) + 1, len(tokens)) AS tokens FROM cleaned),
p AS (SELECT article_id, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM short),
i AS (SELECT article_id, list(CASE WHEN v.id < 30000 THEN v.id ELSE 1 END ORDER BY pos) AS ids FROM p LEFT JOIN vocab v USING (token) GROUP BY article_id)
SELECT s.article_id, {padded('coalesce(ids, [])', 500)} AS ids FROM short s LEFT JOIN i USING (article_id)""",
    "pair_ids": f"""WITH {vocab('<pad>', '<unk>', '<cls>', '<sep>')},
sides AS (SELECT article_id, {words('title')} AS t, {words('content')} AS c FROM articles),
lens AS (SELECT *, least(len(t), greatest(127, 253 - len(c))) AS tl, least(len(c), greatest(126, 253 - len(t))) AS cl FROM sides),
toks AS (SELECT article_id, tl, cl, list_concat(['<cls>'], list_slice(t, 1, tl), ['<sep>'], list_slice(c, 1, cl), ['<sep>']) AS tokens FROM lens),
p AS (SELECT article_id, tl, cl, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM toks),
i AS (SELECT article_id, tl, cl, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM p LEFT JOIN vocab v USING (token) GROUP BY ALL)
SELECT article_id, {padded('ids', 256)} AS ids,
  array_to_string(list_transform(range(0, 256), lambda x: CASE WHEN x < tl + cl + 3 THEN 1 ELSE 0 END), ' ') AS mask,
  array_to_string(list_transform(range(0, 256), lambda x: CASE WHEN x >= tl + 2 AND x < tl + cl + 3 THEN 1 ELSE 0 END), ' ') AS segments FROM i""",
    "embedding_matrix": f"""WITH {VECTORS}, x AS (SELECT v.id, v.token, wd.dim, coalesce(wd.x, 0) AS v FROM vocab v LEFT JOIN wd USING (token))
SELECT {summary('id, token')} FROM x GROUP BY id, token""",
    "in_vocabulary_tokens": f"""WITH {VECTORS} SELECT article_id, count(*) AS n_known FROM (SELECT article_id, unnest(tokens) AS token FROM full_text)
WHERE token IN (SELECT token FROM wv) GROUP BY article_id""",
    "sentence_vec": f"WITH {means('content')} SELECT article_id, CAST(dim AS INTEGER) AS dim, {r6('v', 'v')} FROM sv",
    "sentence_cosine": f"""WITH {means('title content')},
j AS (SELECT article_id, dim, sum(CASE side WHEN 'title' THEN v ELSE 0 END) AS t, sum(CASE side WHEN 'content' THEN v ELSE 0 END) AS c FROM sv GROUP BY ALL)
SELECT article_id, {r6('coalesce(sum(t * c) / nullif(sqrt(sum(t * t)) * sqrt(sum(c * c)), 0), 0)', 'cos_sim')} FROM j GROUP BY article_id""",
    "mean_vec_cosine": f"""WITH {means('content')}, m AS (SELECT dim, avg(v) AS m FROM sv GROUP BY dim)
SELECT article_id, {r6('coalesce(sum(v * m) / nullif(sqrt(sum(v * v)) * sqrt(sum(m * m)), 0), 0)', 'cos_vec_mean')} FROM sv JOIN m USING (dim) GROUP BY article_id""",
    "mean_sentence_vec": f"WITH {means('content')} SELECT CAST(dim AS INTEGER) AS dim, {r6('avg(v)', 'v')} FROM sv GROUP BY dim",
    "oov_backoff": f"""WITH {VECTORS},
known AS (SELECT token, unnest({GRAMS}) AS gram FROM wv),
gv AS (SELECT gram, dim, avg(x) AS x FROM known JOIN wd USING (token) GROUP BY ALL),
rare AS (SELECT token, {GRAMS} AS grams FROM vocab WHERE id > 1 AND token NOT IN (SELECT token FROM wv)),
hit AS (SELECT token, gram FROM (SELECT token, unnest(grams) AS gram FROM rare) WHERE gram IN (SELECT gram FROM known)),
n AS (SELECT token, count(*) AS grams FROM hit GROUP BY token),
bv AS (SELECT token, dim, avg(x) AS v FROM hit JOIN gv USING (gram) GROUP BY ALL),
x AS (SELECT r.token, coalesce(n.grams, 0) AS grams, bv.dim, coalesce(bv.v, 0) AS v FROM rare r LEFT JOIN n USING (token) LEFT JOIN bv USING (token))
SELECT {summary('token, grams')} FROM x GROUP BY token, grams""",
    "pair_embedding_cosine": f"""WITH p AS (SELECT a.vec_id AS article_id, unnest(a.embedding)::DOUBLE AS t, unnest(b.embedding)::DOUBLE AS c
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT article_id, {r6('coalesce(sum(t * c) / nullif(sqrt(sum(t * t)) * sqrt(sum(c * c)), 0), 0)', 'cos_sim')} FROM p GROUP BY article_id""",
    "class_weights": f"""WITH {LABEL_ROWS}, c AS (SELECT label, count(*) AS n FROM label_rows WHERE label IS NOT NULL GROUP BY label)
SELECT label, n, {r6('(SELECT sum(n) / count(*) FROM c) / n', 'weight')} FROM c""",
    "split_hash": f"WITH {LABEL_ROWS} SELECT *, CAST(substr(md5('42:' || doc_id), 1, 8) < '19999999' AS INTEGER) AS holdout FROM label_rows",
    "split_quota": f"""WITH {LABEL_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS place,
  count(*) OVER (PARTITION BY label) AS n FROM label_rows)
SELECT doc_id, label, CAST(place <= round(n * 0.1::DOUBLE) AS INTEGER) AS holdout FROM r""",
    "split_tail": f"""WITH {LABEL_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM label_rows)
SELECT doc_id, label, CAST(place > floor(n * 0.8::DOUBLE) AS INTEGER) AS holdout FROM r""",
    "one_hot": f"WITH {LABEL_ROWS} SELECT doc_id, 1 - label AS y0, label AS y1 FROM label_rows",
    "softmax_score": f"WITH {LOGITS} SELECT doc_id, {r6(PROB, 'prob')} FROM logits",
    "decide": f"WITH {LOGITS} SELECT doc_id, CAST(logit1 > -logit1 AS INTEGER) AS by_argmax, CAST({PROB} >= 0.5 AS INTEGER) AS by_threshold FROM logits",
    "predicted_fake": f"WITH {ARTICLES}, {PREDICTIONS} SELECT article_id, title, prob, pred FROM articles JOIN predictions ON doc_id = article_id WHERE pred = 1",
    "confusion": f"""WITH {PREDICTIONS} SELECT CAST(g.y AS INTEGER) AS y, CAST(g.pred AS INTEGER) AS pred, count(p.doc_id) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(y, pred) LEFT JOIN predictions p ON p.y = g.y AND p.pred = g.pred GROUP BY g.y, g.pred""",
    "accuracy": f"WITH {PREDICTIONS} SELECT {r6('avg(CAST(y = pred AS INTEGER))', 'accuracy')} FROM predictions",
    "prf": f"WITH {PREDICTIONS}, {RATES} SELECT {r6('acc', 'accuracy')}, {r6('p1', 'precision')}, {r6('r1', 'recall')}, {r6('f1', 'f1')} FROM rates",
    "class_report": f"""WITH {PREDICTIONS}, {RATES}, r AS (
SELECT '0' AS class, p0 AS p, r0 AS r, f0 AS f, s0 AS support FROM rates UNION ALL SELECT '1', p1, r1, f1, s1 FROM rates UNION ALL
SELECT 'accuracy', NULL, NULL, acc, s0 + s1 FROM rates UNION ALL
SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM rates UNION ALL
SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM rates)
SELECT class, support, {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('f', 'f1')} FROM r""",
    "auroc": f"WITH {PREDICTIONS}, {AUROC} SELECT {r6('auroc', 'auroc')} FROM area",
    "roc_curve": f"""WITH {PREDICTIONS}, {CURVE} SELECT prob AS threshold, {r6('fp / n', 'fpr')}, {r6('tp / p', 'tpr')} FROM cum, tot
UNION ALL SELECT 'Infinity'::DOUBLE, 0::DOUBLE, 0::DOUBLE""",
    "pr_curve": f"""WITH {PREDICTIONS}, {CURVE} SELECT prob AS threshold, {r6('tp / (tp + fp)', 'precision')}, {r6('tp / p', 'recall')} FROM cum, tot
UNION ALL SELECT NULL, 1::DOUBLE, 0::DOUBLE""",
    "log_loss": f"""WITH {PREDICTIONS}, c AS (SELECT y, greatest(1e-15::DOUBLE, least(prob, 1 - 1e-15::DOUBLE)) AS p FROM predictions)
SELECT {r6('avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END))', 'log_loss')} FROM c""",
    "pearson": f"WITH {PREDICTIONS} SELECT {r6('corr(y, prob)', 'pearson_r')} FROM predictions",
    "best_step": f"""WITH {HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, step) AS place FROM history)
SELECT metric, step, {r6('value', 'value')} FROM o WHERE place = 1""",
    "clipped_history": f"WITH {HISTORY} SELECT metric, step, {r6('greatest(0, least(value / 100, 1))', 'clipped_loss')} FROM history",
    "csv_roundtrip": f"WITH {ARTICLES}, {LABELLED} SELECT article_id, title, content, label FROM labelled",
    "csv_by_name": f"WITH {ARTICLES}, {LABELLED} SELECT article_id, title, content, label FROM labelled",
    "load_articles": f"""WITH {ARTICLES}, {LABELLED},
rows_ AS (SELECT title, content, label FROM labelled WHERE article_id % 2 = 0 UNION ALL
  SELECT {respelled('title')} AS title, {respelled('content')} AS content, NULL AS label FROM articles WHERE article_id % 2 = 1)
SELECT title, content, CAST(label AS INTEGER) AS label, (SELECT count(*) FROM articles) AS ids FROM rows_""",
    "legacy_csv": f"WITH {ARTICLES} SELECT article_id, {respelled('title')} AS title, {respelled('content')} AS content FROM articles",
    "encoding_scan": f"""WITH {ARTICLES} SELECT article_id, CASE WHEN article_id % 3 = 2 THEN '햏' ELSE '' END || {respelled('title')} AS title,
{respelled('content')} AS content, CASE article_id % 3 WHEN 0 THEN 'utf-8-sig' WHEN 1 THEN 'euc-kr' ELSE 'cp949' END AS encoding FROM articles""",
    "export_predictions": f"WITH {PREDICTIONS} SELECT p.doc_id, d.text AS content, p.pred, p.prob FROM predictions p JOIN documents d USING (doc_id)",
    "export_metrics": f"""WITH {PREDICTIONS}, {RATES}, {AUROC} SELECT {r6('acc', '"Accuracy"')}, {r6('p1', '"Precision"')}, {r6('r1', '"Recall"')},
{r6('f1', '"F1"')}, {r6('auroc', '"ROC-AUC"')}, {r6('auroc', '"AUROC"')} FROM rates, area""",
    "study_reload": reloaded("documents", "doc_id"),
    "context_reload": reloaded("documents", "doc_id"),
    "vector_reload": reloaded("documents", "doc_id"),
    "embedding_reload": reloaded("embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "a.vec_id"),
    "cooccurrence": f"""WITH {PAIRS} SELECT token, count(*) AS n_contexts, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(max(n) AS BIGINT) AS most,
CAST(sum(CASE WHEN token = context THEN n ELSE 0 END) AS BIGINT) AS n_self FROM pairs GROUP BY token""",
    "ppmi_weights": f"""WITH {PAIRS}, totals AS (SELECT token, CAST(sum(n) AS DOUBLE) AS own FROM pairs GROUP BY token),
w AS (SELECT p.token, ln(n * (SELECT sum(own) FROM totals) / (a.own * b.own * 2)) AS w FROM pairs p JOIN totals a ON a.token = p.token JOIN totals b ON b.token = p.context)
SELECT token, count(*) AS n_positive, round(sum(w), 4) AS weight FROM w WHERE w > 0 GROUP BY token""",
    "spectral_vec": f"""WITH {ARTICLES}, {FULL}, {COUNTS} SELECT count(*) AS n_words, CAST(0 AS BIGINT) AS wrong_length, CAST(0 AS BIGINT) AS not_square
FROM counts WHERE cnt >= 2""",
    "epoch_history": """SELECT metric, CAST(10 AS BIGINT) AS epochs, CAST(2 AS BIGINT) AS splits, CAST(20 AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS wrong,
CAST(1 AS INTEGER) AS best_kept FROM (SELECT unnest(['loss_1', 'accuracy_1']) AS metric)""",
}
