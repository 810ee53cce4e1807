"""DuckDB SQL for the queries that SQL can express, written apart from the operators: by brute force over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


#: Every window of an item against every place of every document; places are counted one by one.
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
spot AS MATERIALIZED (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(s)),
hit AS MATERIALIZED (SELECT spot.doc_id, spot.s, spot.n, win.item FROM spot JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM hit), unnest(range(s, s + n)) AS u(p) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: All pairs with a shingle in common, compared on their full sets; components by walking the links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", r"[^\x20\x09-\x0D]+")} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(s) WHERE len(w) > 0),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM same JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(src, dst) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.src, l.b FROM reach r JOIN link l ON r.dst = l.a),
root AS (SELECT src AS doc_id, min(dst) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN size USING (doc_id) JOIN root USING (doc_id)"""

#: Each rule by itself; a line is frequent on a host with 20 documents or more that are 1 % or more of the host's.
QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, line, CAST(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM d, unnest(string_split(text, chr(10))) AS u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
host AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY 1),
frequent AS (SELECT l.source, norm FROM l JOIN host ON l.source IS NOT DISTINCT FROM host.source GROUP BY l.source, norm, docs HAVING count(DISTINCT doc_id) >= 20 AND 100 * count(DISTINCT doc_id) >= docs),
left_over AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS gone FROM l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY 1),
win AS MATERIALIZED (SELECT doc_id, s, array_to_string(w[s : s + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(s)),
again AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT s + k) AS n_repeat_words FROM win JOIN again USING (doc_id, g), unnest(range(3)) AS u(k) GROUP BY 1),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone, 0) AS BIGINT) AS n_words_left
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN left_over USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_left >= 30 * n_words AS kept FROM r"""

#: The unsigned crc32 of a decimal number by its bits: for each byte its exclusive or and eight shifts.
_CRC = """CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END), 4294967295) AS BIGINT)"""


def _merkle(levels: int = 14) -> str:
    """A level at a time: ``t`` numbers the trees (a source each, and 0 for the tree over them), a node is kept until its tree is down to one; proofs and folds walk up the same levels."""
    leaf = lambda text: "sha256(concat(" + ", ".join(f"coalesce(concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', CAST({c} AS VARCHAR)), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    out = [
        f"d AS MATERIALIZED (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents)",
        f"l AS MATERIALIZED (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) AS BIGINT) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS p, {leaf('text')} AS leaf, {leaf('other')} AS now FROM d)",
    ]

    def up(name: str, first: str) -> None:
        out.append(f"{name}0 AS MATERIALIZED (SELECT t, p, h, count(*) OVER (PARTITION BY t) AS n FROM ({first}))")
        for k in range(levels):
            grown = f"SELECT t, p // 3 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{k} WHERE n > 1 GROUP BY t, p // 3"
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT t, p, h, count(*) OVER (PARTITION BY t) AS n FROM ({grown}))")
            out.append(f"{name}b{k} AS MATERIALIZED (SELECT t, p, n, coalesce((SELECT string_agg(h, '' ORDER BY p) FROM {name}{k} s WHERE s.t = x.t AND s.p // 3 = x.p // 3 AND s.p < x.p), '') AS a, coalesce((SELECT string_agg(h, '' ORDER BY p) FROM {name}{k} s WHERE s.t = x.t AND s.p // 3 = x.p // 3 AND s.p > x.p), '') AS z FROM {name}{k} x WHERE n > 1)")

    up("s", "SELECT t, p, leaf AS h FROM l")
    out.append("sub AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT t, h FROM s{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    up("r", "SELECT 0 AS t, row_number() OVER (ORDER BY t) - 1 AS p, h FROM sub")
    out.append("top AS (" + " UNION ALL ".join(f"SELECT h FROM r{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    out.append("w0 AS (SELECT doc_id, t, p, leaf, now AS f, '' AS proof FROM l)")
    for k in range(levels):
        out.append(f"w{k + 1} AS (SELECT w.doc_id, w.t, w.p // 3 AS p, leaf, CASE WHEN b.n IS NULL THEN f ELSE sha256(concat(a, f, z)) END AS f, concat(proof, a, z) AS proof FROM w{k} w LEFT JOIN sb{k} b ON b.t = w.t AND b.p = w.p)")
    out.append(f"v0 AS (SELECT doc_id, leaf, w.t, w.t - 1 AS p, f, proof FROM w{levels} w)")
    for k in range(levels):
        out.append(f"v{k + 1} AS (SELECT doc_id, leaf, v.t, v.p // 3 AS p, CASE WHEN b.n IS NULL THEN f ELSE sha256(concat(a, f, z)) END AS f, concat(proof, a, z) AS proof FROM v{k} v LEFT JOIN rb{k} b ON b.p = v.p)")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.h AS verified FROM v{levels} v JOIN sub USING (t), top"


ORACLE_SQL: dict[str, str] = {"op12_merkle_manifest": _merkle(), "op1_decontamination": DECONTAMINATION, "op7_near_duplicates": NEAR_DUPLICATES, "op9_quality_rules": QUALITY_RULES}
