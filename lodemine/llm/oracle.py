"""DuckDB SQL for the queries of this package that SQL can express."""

ORACLE: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEST_WORDS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def overlaps(documents: str, benchmark: str = "benchmark") -> str:
    """The contamination figures of a documents relation, a row per (row number, document)."""
    return f"""
        d AS (SELECT row_number() OVER () AS rid, doc_id, {TEST_WORDS} AS w FROM {documents}),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {TEST_WORDS} AS w FROM {benchmark}),
        iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS k
               FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
               FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
        hits AS (SELECT rid, s, n, item FROM dw JOIN iw USING (n, k)),
        hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
        hit_items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid),
        overlap AS (SELECT d.rid, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                           sha256(coalesce(items, '')) AS items_sha256,
                           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
                    FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid))"""


ORACLE["op5_decontamination"] = f"WITH {overlaps('documents')} SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM overlap"


SPACED_WORDS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"


def near_copies(documents: str) -> str:
    """Components of a documents relation under links of at least 0.8 between sets of five-word shingles."""
    return f"""
        nd AS (SELECT doc_id, {SPACED_WORDS} AS w FROM {documents}),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
               FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM nd WHERE len(w) > 0)),
        sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM nd UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        comp AS (SELECT nd.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id
                 FROM nd JOIN reach ON reach.a = nd.doc_id LEFT JOIN sz ON sz.doc_id = nd.doc_id GROUP BY nd.doc_id)"""


ORACLE["op6_ngram_join"] = f"WITH RECURSIVE {near_copies('documents')} SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id FROM comp"

ORACLE["op4_reply_trees"] = r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    e AS (
        SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS safe,
            replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS safe_role,
            CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
        FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
        CAST(sum(length('### ' || safe_role || ': ' || safe || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM e WHERE conv_id IS NOT NULL GROUP BY conv_id"""

ORACLE["op10_archives"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS first FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
    FROM q"""


# Filters as a bit set, then all orders and steps of the letters.
ORACLE["op12_filter_audit"] = r"""
    WITH w AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    least AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
    lab AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    fails AS (
        SELECT w.doc_id, part, coalesce(good = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
            (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS f
        FROM w JOIN least USING (t) LEFT JOIN lab ON lab.doc_id = w.doc_id),
    sets AS (SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e
        WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    steps AS (SELECT filter_order, s AS step, filter_order[s] AS l, filter_order[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
    met AS (
        SELECT part, filter_order, step, l, f, good, toxic, n, contains(f, l) AS hit,
            before <> '' AND regexp_matches(f, '[' || CASE before WHEN '' THEN '-' ELSE before END || ']') AS gone
        FROM sets, steps),
    counted AS (
        SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
            coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (f = l), 0) AS unique_fails,
            coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS toxic_lost
        FROM met GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
        CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
    FROM counted"""
