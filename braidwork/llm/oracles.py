"""DuckDB SQL of the longer queries."""

#: CRC-32 in SQL: its 256 table entries by the rule that makes them, then a text by its UTF-8 bytes.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) AS entries FROM range(256) t(i))"


def _crc(text: str) -> str:
    code = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::int, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {code}), lambda a, x: xor(a >> 8, entries[(xor(a, x) & 255) + 1])), 4294967295)"


ORACLES = {
    "op12_prefix_trie": f"""
        WITH {_CRC_TABLE},
        turns AS (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("conv_id::varchar")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
        parts AS (
          SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
          UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
        paths AS (
          SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS path
          FROM convs c LEFT JOIN parts USING (conv_id) GROUP BY c.conv_id),
        members AS (SELECT conv_id, path[1:d] AS node, d, d = len(path) AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
        nodes AS (
          SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
          FROM members GROUP BY node),
        children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        own AS (
          SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].text) ELSE 0 END AS saved
          FROM nodes n LEFT JOIN children USING (node)),
        above AS (SELECT node[1:d] AS node, (n_children = 0)::int AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own)),
        below AS (SELECT node, sum(leaf)::bigint AS n_leaves, sum(saved)::bigint AS saved_tokens FROM above GROUP BY node)
        SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends_sha256
        FROM own o JOIN below USING (node) LEFT JOIN nodes p ON o.depth > 0 AND p.node = o.node[1:o.depth - 1]""",
    "op13_importance": rf"""
        WITH {_CRC_TABLE},
        texts AS (SELECT doc_id, 0 AS origin, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
        words AS (
          SELECT doc_id, origin, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
          FROM texts),
        stood AS (SELECT doc_id, origin, unnest(ws) AS w FROM words),
        dictionary AS (SELECT w, count(*) FILTER (WHERE origin = 0) AS s, count(*) FILTER (WHERE origin = 1) AS t FROM stood GROUP BY w),
        hashed AS (SELECT w, s, t, {_crc("w")} % 10000 AS bucket FROM dictionary, crc_table),
        buckets AS (SELECT bucket, sum(s)::double AS s, sum(t)::double AS t FROM hashed GROUP BY bucket),
        totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM buckets),
        gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::bigint AS gain FROM buckets, totals),
        gained AS (SELECT doc_id, sum(gain) AS gained FROM stood JOIN hashed USING (w) JOIN gains USING (bucket) WHERE origin = 0 GROUP BY doc_id),
        weighed AS (
          SELECT doc_id, len(ws) AS n_features, CASE WHEN len(ws) > 0 THEN floor(gained / len(ws))::bigint ELSE 0 END AS weight
          FROM words LEFT JOIN gained USING (doc_id) WHERE origin = 0),
        scored AS (
          SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score FROM weighed),
        eligible AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20),
        drawn AS (SELECT doc_id, rank FROM eligible WHERE rank <= n * 10 // 100)
        SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)""",
}
