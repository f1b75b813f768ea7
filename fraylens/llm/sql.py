"""DuckDB SQL for the registered operators that SQL can express."""

from __future__ import annotations

from fraylens.llm.licenses import COPYRIGHT, KNOWN, LINE_STEM, LOWER, PUNCTUATION, SPELLINGS, UPPER
from fraylens.llm.mixing import Mix


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ESCAPED = "replace(replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '[', '\\i'), ']', '\\r')"

CHAT = f"""
WITH said AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM said
), sized AS (
    SELECT *, sum(9 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))
        OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS until
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(until) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

TOP_K = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.terms, v.terms), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
    FROM rows q JOIN rows v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _canonical(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, {_text(COPYRIGHT)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_text(PUNCTUATION)}, ' ', 'g')"
    for written, meant in SPELLINGS:
        out = f"replace({out}, {_text(written)}, {_text(meant)})"
    return f"trim({out}, ' ')"


_KNOWN_ROWS = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in KNOWN)

LICENSES = f"""
WITH known AS (
    SELECT sha256({_canonical("text")}) AS digest, list_sort(list_distinct(list(license_id))) AS ids
    FROM (VALUES {_KNOWN_ROWS}) AS t(license_id, text) GROUP BY 1
), docs AS (
    SELECT row_number() OVER () AS row, doc_id, text, sha256({_canonical("text")}) AS whole FROM documents
), lines AS (
    SELECT row, unnest(string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10))) AS line FROM docs
), hits AS (
    SELECT row, ids FROM lines JOIN known ON sha256({_canonical("line")}) = digest WHERE contains(line, '{LINE_STEM}')
), noticed AS (
    SELECT row, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(ids)))), ',') AS notices FROM hits GROUP BY row
)
SELECT doc_id, whole AS canonical_sha256, coalesce(array_to_string(ids, ','), '') AS license_ids, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notice_ids
FROM docs LEFT JOIN known ON whole = digest LEFT JOIN noticed USING (row)
"""


def _weights(column: str, weights: dict[str, int]) -> str:
    cases = "".join(f" WHEN {_text(k)} THEN {w}" for k, w in weights.items())
    return f"(CASE {column}{cases} ELSE 1 END)" if cases else "1"


def _level(name: str, nodes: str, parent: str, key: str, out: str) -> str:
    """Two common table expressions that share the budget ``given`` among siblings."""
    order = f"(PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_at AS (
    SELECT *, CAST(given - coalesce(sum(cap) OVER {order}, 0) AS DOUBLE)
        / CAST(sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER {order}, 0) AS DOUBLE) AS level,
        sum(cap) OVER (PARTITION BY {parent}) AS all_caps
    FROM ({nodes}) WHERE weight > 0
), {name} AS (
    SELECT {out}, CAST(CASE WHEN given >= all_caps THEN cap
        ELSE least(cap, CAST(floor(weight * max(level) OVER (PARTITION BY {parent})) AS BIGINT)) END AS BIGINT) AS budget
    FROM {name}_at
)"""


def mixing(mix: Mix) -> str:
    return f"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'd-'
            ELSE 'd' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) END AS domain,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
    FROM documents
), leaves AS (
    SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(sum(n_tokens) * {mix.epochs} AS BIGINT) AS cap
    FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0
), {_level("domains", f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_weights('domain', mix.domains)} AS weight, 1 AS root, (SELECT CAST(floor(sum(available) * CAST({mix.share} AS DOUBLE)) AS BIGINT) FROM leaves) AS given FROM leaves GROUP BY domain", "root", "domain", "domain")},
{_level("langs", f"SELECT l.domain, l.lang, CAST(sum(l.cap) AS BIGINT) AS cap, {_weights('l.lang', mix.languages)} AS weight, any_value(d.budget) AS given FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang", "domain", "lang", "domain, lang")},
{_level("sources", f"SELECT l.*, {_weights('l.source', mix.sources)} AS weight, g.budget AS given FROM leaves l JOIN langs g USING (domain, lang)", "domain, lang", "source", "domain, lang, source, available")},
plan AS (
    SELECT domain, lang, source, budget // available AS whole, budget % available AS rest FROM sources WHERE budget > 0
), placed AS (
    SELECT d.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{mix.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM docs d JOIN plan USING (domain, lang, source)
), counted AS (
    SELECT *, whole + CASE WHEN begins < rest THEN 1 ELSE 0 END AS times FROM placed
)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, n_tokens
FROM (SELECT *, unnest(range(CAST(times AS BIGINT))) AS epoch FROM counted WHERE times > 0)
"""


COLLOCATIONS = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), numbered AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), spread AS (
    SELECT lang, piece, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM numbered
), ahead AS (
    SELECT lang, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c, lead(a, 3) OVER w AS d, lead(a, 4) OVER w AS e
    FROM spread WINDOW w AS (PARTITION BY piece ORDER BY i)
), counted AS (
    SELECT lang, a AS phrase, 1 AS k, count(*) AS f FROM ahead GROUP BY ALL
    UNION ALL SELECT lang, concat_ws(' ', a, b), 2, count(*) FROM ahead WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, concat_ws(' ', a, b, c), 3, count(*) FROM ahead WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, concat_ws(' ', a, b, c, d), 4, count(*) FROM ahead WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, concat_ws(' ', a, b, c, d, e), 5, count(*) FROM ahead WHERE e IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), long AS (
    SELECT lang, phrase, k, f, string_split(phrase, ' ') AS words FROM counted WHERE k > 1 AND f >= 100
), inner_phrases AS (
    SELECT DISTINCT l.lang, array_to_string(l.words[i:i + size - 1], ' ') AS phrase, l.f
    FROM long l, (VALUES (2), (3), (4)) AS sizes(size), (VALUES (1), (2), (3), (4)) AS places(i) WHERE size < l.k AND i + size - 1 <= l.k
), candidates AS (
    SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM inner_phrases p WHERE p.lang = l.lang AND p.phrase = l.phrase AND 100 * p.f >= 100 * l.f)
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, cut, t.n, x.f AS l, y.f AS r,
        (1000 * CAST(c.f AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
    FROM candidates c JOIN (VALUES (1), (2), (3), (4)) AS places(cut) ON cut < c.k JOIN totals t ON t.lang = c.lang
    JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:cut], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1:c.k], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""

_BENCH_WORDS = "regexp_extract_all(translate(coalesce({}, ''), '" + f"{UPPER}', '{LOWER}" + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_BENCH_WORDS.format("text")} AS words FROM documents
), items AS (
    SELECT row_number() OVER () AS item, coalesce(CAST(item_id AS VARCHAR), '') AS id, {_BENCH_WORDS.format("text")} AS words FROM benchmark
), windows AS (
    SELECT DISTINCT id, k, phrase FROM (
        SELECT id, 10 AS k, array_to_string(words[i:i + 9], ' ') AS phrase FROM (SELECT id, words, unnest(range(1, len(words) - 8)) AS i FROM items WHERE len(words) >= 10)
        UNION ALL SELECT id, len(words), array_to_string(words, ' ') FROM items WHERE len(words) BETWEEN 1 AND 9
    )
), spread AS (
    SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs
), places AS (
    SELECT row, i, k, string_agg(w, ' ') OVER (PARTITION BY row, k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS phrase, w
    FROM spread, (SELECT DISTINCT k FROM windows WHERE k = 10)
    UNION ALL SELECT s.row, s.i, z.k, (SELECT array_to_string(d.words[s.i:s.i + z.k - 1], ' ') FROM docs d WHERE d.row = s.row), s.w
    FROM spread s, (SELECT DISTINCT k FROM windows WHERE k < 10) z
), hits AS (
    SELECT p.row, p.i, p.k, w.id FROM places p JOIN windows w ON w.k = p.k AND w.phrase = p.phrase
), covered AS (
    SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT row, i, k FROM hits)) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, id FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

PREFIX_TRIE = """
WITH numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), sized AS (
    SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS id FROM numbered GROUP BY conv_id
), hashed AS ( -- CRC-32 of the id, bit by bit
    SELECT conv_id, n, id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
        list_transform(range(8 * length(id)), lambda i: CAST((ascii(id[i // 8 + 1:i // 8 + 1]) >> (i % 8)) & 1 AS BIGINT))),
        lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h
    FROM sized
), convs AS (
    SELECT c.conv_id, c.h, least(c.h, coalesce(b.n, 0)) AS took, c.conv_id - c.conv_id % 100 AS base
    FROM hashed c LEFT JOIN sized b ON b.conv_id = c.conv_id - c.conv_id % 100
), turns AS (
    SELECT c.conv_id, n.k AS d, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.k <= c.took
    UNION ALL SELECT c.conv_id, c.took + n.k - c.h, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.k > c.h
), paths AS (
    SELECT conv_id, d, length(text) AS size, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS node,
    FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), linked AS (
    SELECT *, lag(node) OVER w AS parent, lead(d) OVER w IS NULL AS ends FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY d)
), nodes AS (
    SELECT node, d, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM linked GROUP BY node, d
), kids AS (
    SELECT parent AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent
), below AS (
    SELECT a.node, sum(n.saved) AS saved, count(*) FILTER (k.node IS NULL) AS leaves
    FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN kids k ON k.node = n.node GROUP BY a.node
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
    b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.parent AND n.d > 0
"""


ORACLES = {
    "op3_chat_formatting": CHAT, "op6_exact_top_k": TOP_K, "op7_license_scans": LICENSES, "op10_source_mixing": mixing(Mix()),
    "op11_phrase_collocations": COLLOCATIONS, "op12_benchmark_decontamination": DECONTAMINATION,
    "op13_conversation_prefix_trie": PREFIX_TRIE,
}
