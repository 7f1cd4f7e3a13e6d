"""DuckDB SQL for the operators that SQL can express."""

from .quality_rules import DIGITS, SPREADS, WEIGHT


def _bucket(value: str) -> str:
    shift = f"greatest(length(bin(({value})::BIGINT)) - {DIGITS}, 0)::INTEGER"
    return f"((({value})::BIGINT >> ({shift})) << ({shift}))"


def _blended(name: str, own: str, above: str, keys: str, held_by: str) -> str:
    """own counts plus WEIGHT documents spread like those of the group above, in whole numbers."""
    on = f"{held_by}, metric" if held_by else "metric"
    return f"""{name} AS (SELECT {keys}, metric, bucket, sum(n)::HUGEINT AS n FROM (
    SELECT {keys}, metric, bucket, n * t AS n FROM {own} JOIN (SELECT {on}, sum(n)::HUGEINT AS t FROM {above} GROUP BY {on}) USING ({on})
    UNION ALL SELECT {keys}, metric, bucket, {WEIGHT} * n FROM (SELECT DISTINCT {keys}, metric FROM {own}) JOIN {above} USING ({on})) GROUP BY {keys}, metric, bucket)"""


def _inside() -> str:
    out = []
    for m, (least, low) in SPREADS.items():
        spread = f"3 * greatest(f.{m}_3 - f.{m}_1, {least})"
        out.append(f"s.{m} <= f.{m}_3 + {spread}")
        if low:
            out.append(f"s.{m} >= f.{m}_1 - {spread}")
    return " AND ".join(out)


_LONG = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS bucket FROM s" for m in SPREADS)
_PICKED = ", ".join(f"max(q1) FILTER (metric = '{m}') AS {m}_1, max(q3) FILTER (metric = '{m}') AS {m}_3" for m in SPREADS)

_RULES = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines FROM t),
v AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS v FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
e AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, v) AS n FROM v) WHERE n > 1),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM e) GROUP BY k),
b AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines
    FROM w LEFT JOIN r ON r.k = w.k),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN {_bucket("1000 * n_symbols // word_chars")} ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN {_bucket("1000 * n_dup_lines // n_lines")} ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN {_bucket("10 * word_chars // n_words")} ELSE 0 END AS word_tenths FROM b),
m AS ({_LONG}),
g AS (SELECT lang, source, metric, bucket, count(*)::HUGEINT AS n FROM m GROUP BY lang, source, metric, bucket),
l AS (SELECT lang, metric, bucket, sum(n)::HUGEINT AS n FROM g GROUP BY lang, metric, bucket),
a AS (SELECT metric, bucket, sum(n)::HUGEINT AS n FROM l GROUP BY metric, bucket),
{_blended("l2", "l", "a", "lang", "")}, {_blended("g2", "g", "l2", "lang, source", "lang")},
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM g2),
q AS (SELECT lang, source, metric, min(bucket) FILTER (4 * cum >= total) AS q1, min(bucket) FILTER (4 * cum >= 3 * total) AS q3 FROM c GROUP BY lang, source, metric),
f AS (SELECT lang, source, {_PICKED} FROM q GROUP BY lang, source)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_inside()} AS kept
FROM s JOIN f ON s.lang = f.lang AND s.source = f.source"""

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(
    [xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)))"""
_TRIE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS b FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
v AS (SELECT n.c, n.c - n.c % 5 AS base, {_CRC.replace("c::", "n.c::")} % 9 AS h FROM n),
r AS (SELECT v.c, t.k AS d, x, b FROM v JOIN t ON t.c = v.base AND t.k <= v.h
    UNION ALL SELECT v.c, t.k - v.h + least(v.h, coalesce(n.n, 0)), x, b FROM v JOIN t ON t.c = v.c AND t.k > v.h LEFT JOIN n ON n.c = v.base),
m AS (SELECT c, d, md5(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS key, b FROM r UNION ALL SELECT c, 0, '', 0 FROM v),
p AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent, max(d) OVER (PARTITION BY c) AS last FROM m),
g AS (SELECT key, min(c) AS conv_id, min(d) AS depth, min(b) AS b, min(parent) AS parent, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256 FROM p GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n FROM g WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT p.key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((g.n - 1) * g.b)::BIGINT AS saved_tokens FROM g JOIN p ON p.c = g.conv_id AND p.d <= g.depth LEFT JOIN k ON k.key = g.key GROUP BY p.key)
SELECT g.conv_id, g.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n AS n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM g JOIN s ON s.key = g.key LEFT JOIN k ON k.key = g.key LEFT JOIN g u ON u.key = g.parent"""

_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, c.id = c.root AS kept FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = c.id"""

ORACLES = {
    "op11_prefix_trie": _TRIE,
    "op12_embedding_dedup": _LINKS,
    "op4_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op8_quality_rules": _RULES,
}
