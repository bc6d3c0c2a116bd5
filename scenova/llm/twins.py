"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations


def grown(state: str, cost: object, letters: str) -> str:
    """A (cost, audit) pair of SQL with more cost and letters, or null."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}'}} END"


def least(*pairs: str) -> str:
    return f"list_min([{', '.join(pairs)}])"


CLOSED = ", ".join(
    [
        "s0 AS t0, s1 AS t1",
        least("s2", grown("s0", 3, "I"), grown("s1", 3, "I"), grown("s3", 3, "I")) + " AS t2",
        least("s3", grown("s2", 3, "I"), grown("s0", 6, "II"), grown("s1", 6, "II")) + " AS t3",
    ]
)


def when(test: str, pair: str) -> str:
    return f"CASE WHEN {test} THEN {pair} END"


TO_USER = [when("NOT gone", grown(t, "3 + extra", "R")) for t in ("t0", "t1", "t3")] + [when("NOT gone AND initial = 'u'", grown(t, "extra", "K")) for t in ("t0", "t1", "t3")]
TO_ASSISTANT = [when("NOT gone", grown("t2", "3 + extra", "R")), when("NOT gone AND initial = 'a'", grown("t2", "extra", "K"))]

#: Checksums from a table of 256 numbers, then four states walked turn by turn, then the turns that the audit leaves.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE
tab AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
),
coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS bytes
    FROM conversations
),
drawn AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS draw FROM coded, tab
),
rows_left AS (
    SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM drawn, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_left),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
        NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS unended
    FROM numbered
),
told AS (
    SELECT conv_id, turn, n, role, text, left(role, 1) AS initial, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND unended AS short,
        lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS following
    FROM placed
),
ready AS (SELECT *, blank OR duplicate AS gone, CASE WHEN short THEN 3 ELSE 0 END AS extra FROM told),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(short) AS truncated,
        count_if(following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
    FROM ready GROUP BY conv_id
),
walk(conv_id, n, s0, s1, s2, s3) AS (
    SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': ''}}, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)), CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)), CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) FROM counts
    UNION ALL
    SELECT conv_id, n, {grown("t0", 4, "D")},
        {least(grown("t1", 4, "D"), when("NOT gone AND initial = 's'", grown("t0", "extra", "K")))},
        {least(grown("t2", 4, "D"), *TO_USER)},
        {least(grown("t3", 4, "D"), *TO_ASSISTANT)}
    FROM (SELECT r.conv_id, r.n, r.gone, r.extra, r.initial, {CLOSED} FROM walk w JOIN ready r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1)
),
ended AS (
    SELECT conv_id, {least("t0", "t3")} AS best FROM (
        SELECT w.conv_id, {CLOSED} FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n_rows = w.n)
),
letters AS (
    SELECT conv_id, p, best.a[CAST(p AS BIGINT)] AS letter, p - count_if(best.a[CAST(p AS BIGINT)] = 'I') OVER (PARTITION BY conv_id ORDER BY p) AS n FROM ended, unnest(range(1, length(best.a) + 1)) u(p)
),
met AS (
    SELECT l.conv_id, l.p, l.letter, CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS text, r.role,
        row_number() OVER (PARTITION BY l.conv_id ORDER BY l.p) AS place,
        first_value(CASE WHEN l.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY l.p) AS opened
    FROM letters l LEFT JOIN ready r ON l.letter <> 'I' AND r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n WHERE l.letter <> 'D'
),
put AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM met GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal,
    CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(put.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN put ON put.conv_id IS NOT DISTINCT FROM o.conv_id
"""

HARD_NEGATIVES = """
WITH held AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.id AS anchor_id, c.id, c.label = a.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
    FROM held a JOIN held c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 50 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n USING (anchor_id) WHERE NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
