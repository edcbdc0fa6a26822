"""DuckDB texts of the queries that SQL can express."""

_WORD = r"'[^\x20\x09-\x0D]+'"

TEXTS: dict[str, str] = {}
TEXTS["op1_chat_formatting"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
                                    '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))
              + length(role) + 23 AS chars
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                           FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
TEXTS["op2_substring_dedup"] = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
suffixes AS (
    SELECT doc_id, pos, array_to_string(words[pos: pos + 34], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM docs)),
twice AS (SELECT win FROM suffixes GROUP BY win HAVING count(*) > 1),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos
    FROM suffixes WHERE win IN (SELECT win FROM twice)),
lists AS (SELECT doc_id, list(pos) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE
           [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(places, i)] END, ' '))
           AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id)
"""
TEXTS["op7_line_dedup"] = rf"""
WITH split_lines AS (
    SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
tokens AS (
    SELECT doc_id, pos, line, [CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END
                              FOR w IN regexp_extract_all(line, {_WORD})] AS t
    FROM split_lines),
paths AS (
    SELECT doc_id, pos, line, len(t) AS n, CASE WHEN len(t) > 16 THEN t ELSE t[1:8] END AS path
    FROM tokens),
usable AS (
    SELECT *, n >= 5 AND 2 * len([w FOR w IN path IF w <> '<*>']) >= n AS ok FROM paths),
recurring AS (
    SELECT n, path, min(doc_id) AS first FROM usable WHERE ok
    GROUP BY n, path HAVING count(DISTINCT doc_id) >= 5),
equal_lines AS (
    SELECT line, min(doc_id) AS first FROM usable WHERE n > 0
    GROUP BY line HAVING count(DISTINCT doc_id) >= 2),
judged AS (
    SELECT u.doc_id, u.pos, u.line, coalesce(r.first <> u.doc_id, false)
           OR coalesce(e.first <> u.doc_id, false) AS gone
    FROM usable u LEFT JOIN recurring r ON u.ok AND u.n = r.n AND u.path = r.path
    LEFT JOIN equal_lines e ON u.n > 0 AND u.line = e.line),
left_over AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE l.text END AS text
FROM documents d LEFT JOIN left_over l USING (doc_id)
"""
TEXTS["op4_near_dedup"] = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS words
    FROM documents),
shingles AS (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words ELSE
        list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END) AS s
    FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 80 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id)
        + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM docs
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d JOIN classes USING (doc_id) LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""
TEXTS["op9_embedding_dedup"] = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
       min(other) AS component_id, e.vec_id = min(other) AS kept
FROM embeddings e JOIN reach USING (vec_id) GROUP BY e.vec_id
"""


def _covered(n: int, first_too: bool) -> str:
    """Word places inside ``n``-word windows found before (or, ``first_too``, found twice)."""
    test = "times > 1" if first_too else "turn > 1"
    return f"""
    SELECT DISTINCT doc_id, unnest(range(pos, pos + {n})) AS pos FROM (
        SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS times,
               row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) AS turn
        FROM (SELECT doc_id, pos, array_to_string(w[pos: pos + {n - 1}], ' ') AS gram
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS pos FROM docs)))
    WHERE {test}"""


def _share(n: int) -> str:
    return f"""
    SELECT doc_id, sum(length(w[pos])) AS chars
    FROM ({_covered(n, False)}) JOIN docs USING (doc_id) GROUP BY doc_id"""


TEXTS["op5_quality_rules"] = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
split_lines AS (
    SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs)),
turns AS (
    SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
           row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS turn
    FROM split_lines WHERE regexp_matches(line, {_WORD})),
dup AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM turns WHERE turn > 1 GROUP BY doc_id),
twice AS (SELECT doc_id, count(*) AS n FROM ({_covered(5, True)}) GROUP BY doc_id),
g5 AS ({_share(5)}), g7 AS ({_share(7)}), g10 AS ({_share(10)}),
measured AS (
    SELECT d.doc_id, len(w) AS n_words,
           CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
           coalesce(dup.n, 0) AS n_dup_lines, coalesce(twice.n, 0) AS n_repeat_words,
           coalesce(dup.chars, 0) AS cl, coalesce(g5.chars, 0) AS c5, coalesce(g7.chars, 0) AS c7,
           coalesce(g10.chars, 0) AS c10
    FROM docs d LEFT JOIN dup USING (doc_id) LEFT JOIN twice USING (doc_id) LEFT JOIN g5 USING (doc_id)
    LEFT JOIN g7 USING (doc_id) LEFT JOIN g10 USING (doc_id)),
judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           CAST(greatest(word_chars, 1) AS DOUBLE) AS total FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND cl / total <= 0.30 AND 100 * n_symbols <= 25 * n_words
           AND c5 / total <= 0.30 AND c7 / total <= 0.25 AND c10 / total <= 0.20 AS kept
FROM judged
"""
_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
TEXTS["op12_lexical_search"] = rf"""
WITH docs AS (
    SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM docs WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
held AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held, total GROUP BY term, nn),
norms AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM sizes, total),
scored AS (
    SELECT item_id, doc_id,
           CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (doc_id)
    GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, doc_id, score, CAST(row_number() OVER (
        PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
