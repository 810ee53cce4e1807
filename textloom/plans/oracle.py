"""DuckDB SQL for the queries, written apart from the operators: chained table expressions over the same tables."""

from __future__ import annotations

from ..functions.stopwords import ENGLISH

V, EPS, MIN_SAMPLES, TOP_N, NAME_TOP_N = 2000, 0.5, 5, 10, 3

STOP = "stop(word) AS (VALUES " + ", ".join(f"('{w}')" for w in ENGLISH) + ")"
EDGE = r"[\s\p{Z}\x1c-\x1f\x85]"
CLEAN = rf"regexp_replace(lower(coalesce(text, '')), '^{EDGE}+|{EDGE}+$', '', 'g')"

TERMS = rf"""{STOP},
    tok AS (SELECT doc_id, unnest(regexp_extract_all({CLEAN}, '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN (SELECT word FROM stop) GROUP BY ALL),
    stat AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term),
    top AS (SELECT * FROM stat ORDER BY cf DESC, term LIMIT {V}),
    vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx, cf, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM top)"""
WEIGHTS = f"""{TERMS},
    w AS (SELECT doc_id, term, tf * idf AS weight FROM tf JOIN vocab USING (term)),
    x AS MATERIALIZED (SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS unit FROM w)"""
PAIRS = f"""{WEIGHTS},
    pairs AS MATERIALIZED (SELECT p.doc_id AS a, q.doc_id AS b FROM x p JOIN x q ON p.term = q.term AND p.doc_id < q.doc_id GROUP BY 1, 2 HAVING greatest(0, round(1 - sum(p.unit * q.unit), 12)) <= {EPS}),
    ends AS (SELECT a AS doc_id FROM pairs UNION ALL SELECT b FROM pairs),
    core AS MATERIALIZED (SELECT d.doc_id, 1 + coalesce(n, 0) AS n_neighbors FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ends GROUP BY 1) e USING (doc_id) WHERE 1 + coalesce(n, 0) >= {MIN_SAMPLES})"""
LABELS = f"""{PAIRS},
    link AS MATERIALIZED (SELECT a, b FROM pairs WHERE a IN (SELECT doc_id FROM core) AND b IN (SELECT doc_id FROM core)),
    both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(src, dst) AS (SELECT doc_id, doc_id FROM core UNION SELECT r.src, l.b FROM reach r JOIN both_ways l ON r.dst = l.a),
    root AS (SELECT src AS doc_id, min(dst) AS root FROM reach GROUP BY 1),
    cores AS MATERIALIZED (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS lab FROM root),
    border AS (SELECT p.b AS doc_id, min(lab) AS lab FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) p JOIN cores c ON p.a = c.doc_id GROUP BY 1),
    labels AS MATERIALIZED (SELECT d.doc_id, coalesce(c.lab, b.lab, -1) AS cluster_label FROM documents d LEFT JOIN cores c USING (doc_id) LEFT JOIN border b USING (doc_id))"""
KEYWORDS = f"""{LABELS},
    size AS (SELECT cluster_label, count(*) AS n FROM labels WHERE cluster_label <> -1 GROUP BY 1),
    means AS MATERIALIZED (SELECT cluster_label, term, sum(unit) / any_value(n) AS mean FROM x JOIN labels USING (doc_id) JOIN size USING (cluster_label) GROUP BY 1, 2),
    allterms AS (SELECT s.cluster_label, v.term, coalesce(m.mean, 0.0) AS mean FROM size s CROSS JOIN vocab v LEFT JOIN means m ON m.cluster_label = s.cluster_label AND m.term = v.term),
    kw AS MATERIALIZED (SELECT * FROM (SELECT cluster_label, CAST(row_number() OVER (PARTITION BY cluster_label ORDER BY round(mean, 9) DESC, term) AS INTEGER) AS rank, term, mean AS score FROM allterms) WHERE rank <= {TOP_N}),
    names AS (SELECT cluster_label, string_agg(replace(term, ' ', '_'), ', ' ORDER BY rank) FILTER (WHERE rank <= {NAME_TOP_N}) AS cluster_name FROM kw GROUP BY 1)"""


def _lloyd(k: int, iterations: int) -> str:
    """Chained assignment and update steps over ``embeddings`` from the ``k`` least ids."""
    out = [
        "vals AS MATERIALIZED (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
        f"first AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS lab FROM (SELECT DISTINCT vec_id FROM vals) ORDER BY vec_id LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT lab, pos, value AS centre FROM vals JOIN first USING (vec_id))",
    ]
    for i in range(iterations + 1):
        out.append(f"d{i} AS (SELECT vec_id, lab, round(sum((value - centre) * (value - centre)), 9) AS d FROM vals JOIN c{i} USING (pos) GROUP BY 1, 2)")
        out.append(f"a{i} AS MATERIALIZED (SELECT vec_id, lab FROM (SELECT vec_id, lab, row_number() OVER (PARTITION BY vec_id ORDER BY d, lab) AS r FROM d{i}) WHERE r = 1)")
        if i < iterations:
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT lab, pos, avg(value) AS centre FROM vals JOIN a{i} USING (vec_id) GROUP BY 1, 2)")
    return "WITH " + ",\n".join(out) + f"\nSELECT vec_id, lab AS cluster_label FROM a{iterations}"


def _kmeans(k: int = 5, restarts: int = 3, seed: int = 42, steps: int = 40, tol: float = 1e-4) -> str:
    """Seeds by the same races over the documents' weights, chained iterations of all restarts until a restart has settled, and the cheapest one's labels, numbered by their least rows."""
    from ..operators.kmeans import BY_RESTART, BY_ROW, BY_STEP, PRIME, SHIFT

    out = [
        WEIGHTS,
        f"runs AS (SELECT unnest(range({restarts})) AS r)",
        "len AS MATERIALIZED (SELECT d.doc_id, coalesce(sum(unit * unit), 0) AS xx FROM documents d LEFT JOIN x USING (doc_id) GROUP BY 1)",
    ]
    base = lambda s: f"((doc_id % {PRIME}) * {BY_ROW} + CAST({BY_STEP * (s + 1) + seed} AS BIGINT) + {BY_RESTART} * (r + 1)) % {PRIME}"
    for s in range(k):
        if s:
            dots = f"SELECT p.doc_id, q.r, sum(p.unit * q.unit) AS dot FROM x p JOIN sv{s - 1} q USING (term) GROUP BY 1, 2"
            seen = f"SELECT l.doc_id, q.r, greatest(0, l.xx + q.xx - 2 * coalesce(dot, 0)) AS d FROM len l JOIN (SELECT r, xx FROM s{s - 1} JOIN len USING (doc_id)) q ON true LEFT JOIN ({dots}) USING (doc_id, r)"
            far = f"SELECT doc_id, r, d FROM ({seen})" if s == 1 else f"SELECT doc_id, r, least(n.d, o.d) AS d FROM ({seen}) n JOIN far{s - 1} o USING (doc_id, r)"
        else:
            far = "SELECT doc_id, r, 1.0 AS d FROM len, runs"
        out.append(f"far{s} AS MATERIALIZED ({far})")
        race = f"SELECT doc_id, r, -ln((((a * a % {PRIME}) * a + {SHIFT}) % {PRIME} + 1.0) / ({PRIME} + 1.0)) / round(d, 9) AS t FROM (SELECT doc_id, r, d, {base(s)} AS a FROM far{s} WHERE round(d, 9) > 0)"
        out.append(f"s{s} AS MATERIALIZED (SELECT r, arg_min(doc_id, (t, doc_id)) AS doc_id FROM ({race}) GROUP BY r)")
        out.append(f"sv{s} AS MATERIALIZED (SELECT r, term, unit FROM s{s} JOIN x USING (doc_id))")
    out.append("c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT r, {s} AS lab, term, unit AS c FROM sv{s}" for s in range(k)) + ")")
    out.append("ids AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT r, {s} AS lab FROM s{s}" for s in range(k)) + ")")
    out.append("f0 AS (SELECT r, false AS done FROM runs)")
    for i in range(steps + 1):
        out.append(f"n{i} AS MATERIALIZED (SELECT ids.r, ids.lab, coalesce(sum(c * c), 0) AS cc FROM ids LEFT JOIN c{i} USING (r, lab) GROUP BY 1, 2)")
        out.append(f"d{i} AS (SELECT doc_id, r, lab, sum(unit * c) AS dot FROM x JOIN c{i} USING (term) GROUP BY 1, 2, 3)")
        out.append(f"e{i} AS MATERIALIZED (SELECT doc_id, r, lab, round(greatest(0, xx + cc - 2 * coalesce(dot, 0)), 9) AS d FROM len JOIN n{i} ON true LEFT JOIN d{i} USING (doc_id, r, lab))")
        out.append(f"a{i} AS MATERIALIZED (SELECT doc_id, r, arg_min(lab, (d, lab)) AS lab, min(d) AS d FROM e{i} GROUP BY 1, 2)")
        if i < steps:
            size = f"(SELECT r, lab, count(*) AS n FROM a{i} GROUP BY 1, 2)"
            new = f"SELECT r, lab, term, sum(unit) / any_value(n) AS c FROM x JOIN a{i} USING (doc_id) JOIN {size} USING (r, lab) JOIN f{i} USING (r) WHERE NOT done GROUP BY 1, 2, 3"
            stay = f"SELECT r, lab, term, c FROM c{i} JOIN f{i} USING (r) LEFT JOIN {size} USING (r, lab) WHERE done OR n IS NULL"
            out.append(f"c{i + 1} AS MATERIALIZED ({new} UNION ALL {stay})")
            shift = f"SELECT r, lab, sqrt(sum((coalesce(p.c, 0) - coalesce(q.c, 0)) * (coalesce(p.c, 0) - coalesce(q.c, 0)))) AS s FROM c{i} p FULL JOIN c{i + 1} q USING (r, lab, term) GROUP BY 1, 2"
            out.append(f"f{i + 1} AS MATERIALIZED (SELECT r, f{i}.done OR coalesce(max(s), 0) <= {tol} AS done FROM f{i} LEFT JOIN ({shift}) USING (r) GROUP BY r, f{i}.done)")
    out.append(f"best AS (SELECT arg_min(r, (c, r)) AS r FROM (SELECT r, round(sum(d), 6) AS c FROM a{steps} GROUP BY r))")
    out.append(f"won AS MATERIALIZED (SELECT doc_id, lab FROM a{steps} JOIN best USING (r))")
    return "WITH " + ",\n".join(out) + "\nSELECT doc_id, CAST(dense_rank() OVER (ORDER BY least) - 1 AS INTEGER) AS cluster_label FROM won JOIN (SELECT lab, min(doc_id) AS least FROM won GROUP BY 1) USING (lab)"


def _pca(steps: int = 12) -> str:
    """Two principal components of ``embeddings`` from repeated squares of the covariance: the power 2 ** ``steps`` leaves the first one, and what remains of the covariance gives the second."""
    out = [
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)",
        "c AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM v)",
        "m0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS x FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2)",
    ]
    for p in (0, 1):
        out.append(f"p{p}s0 AS (SELECT i, j, x FROM m{p})")
        for k in range(steps):
            out.append(f"p{p}q{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM p{p}s{k} a JOIN p{p}s{k} b ON a.j = b.i GROUP BY 1, 2)")
            out.append(f"p{p}s{k + 1} AS MATERIALIZED (SELECT i, j, x / (SELECT max(abs(x)) FROM p{p}q{k}) AS x FROM p{p}q{k})")
        last = f"p{p}s{steps}"
        out.append(f"w{p} AS MATERIALIZED (SELECT i, x FROM {last} WHERE j = (SELECT j FROM {last} WHERE i = j ORDER BY x DESC LIMIT 1))")
        out.append(f"e{p} AS MATERIALIZED (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM w{p}) * (SELECT sign(x) FROM w{p} ORDER BY abs(x) DESC LIMIT 1) AS x FROM w{p})")
        if not p:
            out.append("l0 AS (SELECT sum(a.x * m0.x * b.x) AS l FROM m0 JOIN e0 a ON a.i = m0.i JOIN e0 b ON b.i = m0.j)")
            out.append("m1 AS MATERIALIZED (SELECT m0.i, m0.j, m0.x - (SELECT l FROM l0) * a.x * b.x AS x FROM m0 JOIN e0 a ON a.i = m0.i JOIN e0 b ON b.i = m0.j)")
    out.append("xy AS (SELECT vec_id, round(sum(c.x * e0.x), 6) AS x, round(sum(c.x * e1.x), 6) AS y FROM c JOIN e0 USING (i) JOIN e1 USING (i) GROUP BY 1)")
    return "WITH " + ",\n".join(out) + "\n"


def _pca_documents(steps: int = 50) -> str:
    """Two principal components of the documents' weights: two directions are multiplied by the covariance again and again and made orthogonal, and turned to their axes at the end."""
    out = [
        WEIGHTS,
        "m AS MATERIALIZED (SELECT term, sum(unit) / (SELECT count(*) FROM documents) AS m FROM x GROUP BY 1)",
        "b0 AS (SELECT term, cos(term_idx) AS p, sin(2 * term_idx + 1) AS q FROM vocab)",
    ]
    for i in range(steps + 1):
        off = f"(SELECT sum(m * p) AS mp, sum(m * q) AS mq FROM m JOIN b{i} USING (term))"
        dots = f"SELECT doc_id, sum(unit * p) AS p, sum(unit * q) AS q FROM x JOIN b{i} USING (term) GROUP BY 1"
        out.append(f"z{i} AS MATERIALIZED (SELECT doc_id, coalesce(p, 0) - mp AS p, coalesce(q, 0) - mq AS q FROM documents LEFT JOIN ({dots}) USING (doc_id), {off})")
        if i < steps:
            out.append(f"w{i} AS MATERIALIZED (SELECT term, sum(unit * p) - any_value(m) * (SELECT sum(p) FROM z{i}) AS p, sum(unit * q) - any_value(m) * (SELECT sum(q) FROM z{i}) AS q FROM x JOIN z{i} USING (doc_id) JOIN m USING (term) GROUP BY 1)")
            out.append(f"g{i} AS MATERIALIZED (SELECT term, p / pn AS p, q - pq / (pn * pn) * p AS q FROM w{i}, (SELECT sqrt(sum(p * p)) AS pn, sum(p * q) AS pq FROM w{i}))")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT term, p, q / (SELECT sqrt(sum(q * q)) FROM g{i}) AS q FROM g{i})")
    last = f"b{steps}"
    out.append(f"turn AS (SELECT atan2(2 * sum(p * q), sum(p * p) - sum(q * q)) / 2 AS a FROM z{steps})")
    out.append(f"e AS MATERIALIZED (SELECT term, cos(a) * p + sin(a) * q AS x, cos(a) * q - sin(a) * p AS y FROM {last}, turn)")
    out.append("s AS (SELECT sign(arg_max(x, abs(x))) AS sx, sign(arg_max(y, abs(y))) AS sy FROM e)")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, round(sx * (cos(a) * p + sin(a) * q), 6) AS x, round(sy * (cos(a) * q - sin(a) * p), 6) AS y FROM z{steps}, turn, s"


def _without_limit(sql: str) -> str:
    """The same over all terms."""
    return sql.replace(f" LIMIT {V})", ")")


_L = f"WITH RECURSIVE {LABELS}\n"
_K = f"WITH RECURSIVE {KEYWORDS}\n"

ORACLE_SQL: dict[str, str] = {
    "list_columns": "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, name FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS name)",
    "table_profile_documents": "SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_columns FROM documents",
    "coerce_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "coerce_text_numeric": "SELECT p_partkey, coalesce(CAST(p_size AS VARCHAR), '') AS text FROM part",
    "preprocess_text": f"SELECT doc_id, {CLEAN} AS text FROM documents",
    "blank_profile": f"SELECT count(*) AS n, count(*) FILTER (WHERE {CLEAN} = '') AS n_blank, bool_and({CLEAN} = '') AS all_blank FROM documents",
    "all_blank_labels": "SELECT doc_id, CAST(-1 AS INTEGER) AS cluster_label FROM documents",
    "tokenize": r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ws FROM documents) SELECT doc_id, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS token FROM t",
    "remove_stopwords": rf"WITH t AS (SELECT doc_id, [w for w in regexp_extract_all({CLEAN}, '[\p{{L}}\p{{N}}_]{{2,}}') if NOT list_contains({list(ENGLISH)}, w)] AS ws FROM documents) SELECT doc_id, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS token FROM t",
    "term_frequencies": f"WITH {TERMS} SELECT doc_id, term, tf FROM tf",
    "vocabulary_topk": f"WITH {TERMS} SELECT term, term_idx, cf, df FROM vocab",
    "document_frequency": f"WITH {TERMS} SELECT term, df FROM stat",
    "inverse_document_frequency": f"WITH {TERMS} SELECT term, round(idf, 9) AS idf FROM vocab",
    "tfidf": f"WITH {WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "tfidf_normalized": f"WITH {WEIGHTS} SELECT doc_id, term, round(unit, 6) AS weight FROM x",
    "tfidf_all_terms": _without_limit(f"WITH {WEIGHTS} SELECT doc_id, term, round(unit, 6) AS weight FROM x"),
    "dbscan_labels_all_terms": _without_limit(_L + "SELECT doc_id, cluster_label FROM labels"),
    "cluster_keywords_all_terms": _without_limit(_K + "SELECT cluster_label, rank, term, round(score, 6) AS score FROM kw"),
    "feature_names": f"WITH {TERMS} SELECT term_idx, term FROM vocab",
    "matrix_shape": f"WITH {TERMS} SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM vocab) AS n_features",
    "neighbor_pairs": f"WITH {PAIRS} SELECT a, b FROM pairs",
    "dbscan_core_points": f"WITH {PAIRS} SELECT doc_id, n_neighbors FROM core",
    "dbscan_labels": _L + "SELECT doc_id, cluster_label FROM labels",
    "dbscan_cluster_sizes": _L + "SELECT cluster_label, count(*) AS n FROM labels GROUP BY 1",
    "cluster_ids": _L + "SELECT DISTINCT cluster_label FROM labels",
    "cluster_stats": _L + "SELECT cluster_label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM labels), 1) AS percent FROM labels GROUP BY 1",
    "cluster_count": _L + "SELECT count(DISTINCT cluster_label) AS n_clusters, count(DISTINCT CASE WHEN cluster_label <> -1 THEN cluster_label END) AS n_clusters_excl_noise FROM labels",
    "cluster_term_means": _K + "SELECT cluster_label, term, round(mean, 6) AS mean FROM means",
    "cluster_keywords": _K + "SELECT cluster_label, rank, term, round(score, 6) AS score FROM kw",
    "keyword_lines": _K + "SELECT cluster_label, string_agg(term, ', ' ORDER BY rank) AS keywords FROM kw GROUP BY 1",
    "cluster_names": _K + "SELECT cluster_label, cluster_name FROM names",
    "clustered_with_names": _K + "SELECT doc_id, cluster_label, coalesce(cluster_name, '') AS cluster_name FROM labels LEFT JOIN names USING (cluster_label)",
    "rename_clusters": _K + "SELECT cluster_label, CASE WHEN cluster_label = 0 THEN 'first cluster' ELSE cluster_name END AS cluster_name FROM names",
    "kmeans_labels": _kmeans(),
    "kmeans_fixed_centres": _lloyd(5, 3),
    "pca_documents": _pca_documents(),
    "pca_embedding": _pca() + "SELECT vec_id, x, y FROM xy",
    "plot_frame": _pca() + "SELECT vec_id, x, y, label FROM xy JOIN embeddings USING (vec_id)",
}
