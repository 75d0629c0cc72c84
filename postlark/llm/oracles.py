"""SQL for the queries of this subpackage that SQL can express, as DuckDB runs it."""

from postlark.llm.queries import PROBE_ID, PROBE_TEXT

# Words of a text column; the empty pattern match of a NULL text gives none.
WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

WARC = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (
    SELECT page_id, strlen(payload) AS n, sha1(payload) AS hex,
           max(page_id) OVER (PARTITION BY payload) AS last
    FROM payloads)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT)
                 >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM hashed
"""

TOP = """
WITH vectors AS (
    SELECT vec_id, row_number() OVER () AS r,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x:
        x IS NULL OR isnan(x) OR isinf(x))) = 0),
ranked AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score,
           q.r
    FROM vectors q JOIN vectors c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM ranked WINDOW best AS (PARTITION BY r ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""

NEAR = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
          FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
ties AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(start, node) AS (
    SELECT doc_id, doc_id FROM texts
    UNION SELECT start, b FROM reach JOIN ties ON node = a)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id,
       t.doc_id = r.component_id AS kept
FROM texts t LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT start AS doc_id, min(node) AS component_id FROM reach GROUP BY start) r USING (doc_id)
"""

LEAKS = r"""
WITH lower_items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
texts AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM lower_items WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
places AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM texts, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, p.n, i, item_id FROM places p JOIN windows v USING (phrase) WHERE p.n = v.n),
hit AS (
    SELECT r, count(DISTINCT k) AS n_hit
    FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
named AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

MIX = rf"""
WITH sizes AS (
    SELECT doc_id, source, len({WORDS.format(text="text")}) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR),
                'null ' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
    FROM documents),
ranked AS (
    SELECT source, sum(size) AS s,
           [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
    FROM sizes GROUP BY source),
-- A source is full if all that fill up no later than it leave enough for it.
tried AS (
    SELECT a.source, a.s, a.w,
           3 * (SELECT sum(s) FROM ranked)
             - 4 * coalesce(sum(b.s) FILTER (b.s * a.w < a.s * b.w), 0) AS twice_left,
           sum(b.w) FILTER (b.s * a.w >= a.s * b.w) AS rest
    FROM ranked a CROSS JOIN ranked b GROUP BY ALL),
full_ones AS (SELECT source, s, w, twice_left * w >= 4 * s * rest AS is_full FROM tried),
pool AS (
    SELECT 3 * sum(s) - 4 * coalesce(sum(s) FILTER (is_full), 0) AS twice_left,
           2 * sum(w) FILTER (NOT is_full) AS twice_weight FROM full_ones),
targets AS (
    SELECT source, s, CASE WHEN is_full THEN CAST(2 * s AS DOUBLE)
        ELSE CAST(twice_left * w AS DOUBLE) / CAST(twice_weight AS DOUBLE) END AS target
    FROM full_ones, pool),
budgets AS (
    SELECT source, s, target, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS base
    FROM targets),
units AS (SELECT source, h, sum(size) AS words FROM sizes GROUP BY source, h),
running AS (
    SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS below FROM units),
cut AS (
    SELECT r.source, r.h, r.words, r.below, b.target - b.base * b.s AS budget
    FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
    WHERE r.below <= b.target - b.base * b.s
    QUALIFY row_number() OVER (PARTITION BY r.source ORDER BY r.h DESC) = 1),
limits AS (
    SELECT b.*, CASE WHEN c.below + c.words - c.budget < c.budget - c.below
                     THEN c.h + 1 ELSE c.h END AS threshold
    FROM budgets b JOIN cut c ON b.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(l.s AS BIGINT) AS source_size, target,
       CAST(size * (base + CASE WHEN h < threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes d JOIN limits l ON d.source IS NOT DISTINCT FROM l.source
"""


def _escaped(column: str, role: bool = False) -> str:
    out = rf"replace(replace(replace({column}, '\', '\b'), '#', '\h'), '<', '\l')"
    return rf"replace({out}, ':', '\c')" if role else out


CHAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL
    SELECT {PROBE_ID}, turn, role, '{PROBE_TEXT}'
    FROM (VALUES (0, 'user'), (1, 'assistant')) AS probe(turn, role)),
joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), ''
                      ORDER BY turn NULLS FIRST, role, text) AS whole,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                    FILTER (role = 'assistant'), '') AS loss,
           sum(length({_escaped("role", True)}) + length({_escaped("text")}) + 14) AS chars
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""


# The pages at hand mark their article and hold no element inside it but these.
MAIN = r"""
WITH articles AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS inner_html
    FROM pages),
blocks AS (
    SELECT page_id, url, regexp_replace(
        regexp_replace(inner_html, '</?(h1|p)>|<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS marked
    FROM articles),
decoded AS (
    SELECT page_id, url, regexp_replace(regexp_replace(marked, '&quot;', '"', 'g'), '&amp;?', '&', 'g') AS plain
    FROM blocks),
packed AS (SELECT page_id, url, trim(regexp_replace(plain, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM packed
"""

# CRC-32 of a short text: every byte is taken in, then eight steps of the register.
CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length({text}) + 1),
        lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"""

TRIE = rf"""
WITH numbered AS (
    SELECT conv_id, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS k,
           len({WORDS.format(text="text")}) AS w,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
    SELECT conv_id, {CRC.format(text="CAST(conv_id AS VARCHAR)")} % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM numbered)),
turns AS (
    SELECT c.conv_id, 0 AS own, n.i, n.k, n.w
    FROM heads c JOIN numbered n ON n.conv_id = c.conv_id - c.conv_id % 20 AND n.i <= c.h
    UNION ALL
    SELECT c.conv_id, 1, n.i, n.k, n.w FROM heads c JOIN numbered n USING (conv_id) WHERE n.i > c.h),
placed AS (
    SELECT conv_id, k, w, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM turns),
paths AS (
    SELECT conv_id, d, w, md5(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM placed
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM heads),
lengths AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY conv_id),
nodes AS (
    SELECT node, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                  FILTER (d = n), '')) AS ends_sha256
    FROM paths JOIN lengths USING (conv_id) GROUP BY node),
mothers AS (
    SELECT c.node, p.node AS parent FROM nodes c
    JOIN paths p ON p.conv_id = c.conv_id AND p.d = c.depth - 1),
births AS (SELECT parent AS node, count(*) AS n_children FROM mothers GROUP BY parent),
below AS (
    SELECT p.node, sum(CASE WHEN b.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves,
           sum((c.n_convs - 1) * c.w) AS saved_tokens
    FROM nodes c LEFT JOIN births b USING (node)
    JOIN paths p ON p.conv_id = c.conv_id AND p.d <= c.depth GROUP BY p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs,
       coalesce(b.n_children, 0) AS n_children, CAST(l.n_leaves AS BIGINT) AS n_leaves,
       CAST(l.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below l USING (node) LEFT JOIN births b USING (node)
LEFT JOIN mothers m USING (node) LEFT JOIN nodes q ON q.node = m.parent
"""


def _codes_sql(rounds: int = 2) -> str:
    """Rounds of assigning every part to its nearest entry and moving the entries."""

    def assigned(number: int) -> str:
        return f"""
a{number} AS MATERIALIZED (
    SELECT r, j, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best
    FROM (SELECT p.r, p.j, p.x, c.e, CAST(list_sum(list_transform(list_zip(p.x, c.x),
                 lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) AS d
          FROM parts p JOIN c{number} c USING (j))
    GROUP BY r, j)"""

    def moved(number: int) -> str:
        return f"""
c{number + 1} AS MATERIALIZED (
    SELECT c.j, c.e, coalesce(any_value(m.x), any_value(c.x)) AS x
    FROM c{number} c LEFT JOIN (
        SELECT j, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x
        FROM (SELECT j, best.e AS e, i, sum(x[i]) AS s, count(*) AS n
              FROM a{number}, range(1, 5) AS places(i) GROUP BY ALL) GROUP BY j, e) m
        USING (j, e) GROUP BY c.j, c.e)"""

    steps = ",".join(assigned(n) + "," + moved(n) for n in range(rounds))
    return f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x:
        x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
    SELECT r, j, v[len(v) // 16 * j + 1:len(v) // 16 * (j + 1)] AS x FROM kept, range(16) AS places(j)),
c0 AS MATERIALIZED (SELECT j, r - 1 AS e, x FROM parts WHERE r <= 64),
{steps},
{assigned(rounds)},
coded AS (
    SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY j) AS code,
           CAST(sum(best.d) AS BIGINT) AS error
    FROM a{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label),
books AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       codebooks_sha256
FROM coded, books
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_arc_to_warc": WARC,
        "op2_cover_trees": TOP,
        "op4_hash_mix": MIX,
        "op6_odd_sketches": NEAR,
        "op7_fm_index": LEAKS,
        "op8_prefix_targets": CHAT,
        "op11_scored_region": MAIN,
        "op12_prefix_trie": TRIE,
        "op13_laesa_codes": _codes_sql(),
    }
