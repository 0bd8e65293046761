"""DuckDB statements of the queries that SQL can express."""

from verdigris.llm.licences import TEMPLATES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"


def _words(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


_TEMPLATES = ", ".join(
    f"('{t.label}', {_words(t.words)}, {t.key_at}, {_words(t.key)}, {str(t.base).lower()})" for t in TEMPLATES
)

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
WITH plain AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), best AS (
    SELECT *, first_value(doc_id) OVER (
                 PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ASC NULLS LAST) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256, n_chars FROM best
""",
    "op2_licences": rf"""
WITH wordings(label, wording, key_at, phrase, base) AS (VALUES {_TEMPLATES}),
texts AS (
    SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), near AS (
    SELECT doc_id, words, w.* FROM texts JOIN wordings w
      ON contains(' ' || array_to_string(words, ' ') || ' ', ' ' || array_to_string(phrase, ' ') || ' ')
), places AS (SELECT *, unnest(range(len(words))) AS spot FROM near),
matches AS (
    SELECT doc_id, label, base, spot,
           list_sum(list_transform(range(len(wording)), lambda k: CASE WHEN spot - key_at + k >= 0
               AND words[spot - key_at + k + 1] = wording[k + 1] THEN 1 ELSE 0 END))::DOUBLE / len(wording) AS share
    FROM places WHERE words[spot + 1 : spot + len(phrase)] = phrase
), found AS (
    SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(spot) FILTER (WHERE base) AS first_word,
           max(spot) FILTER (WHERE base) AS last_word, max(share) AS score,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM matches GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM texts LEFT JOIN found USING (doc_id)
""",
    "op7_ngram_join": rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) END) AS shingle
    FROM texts
), sizes AS (
    SELECT doc_id, count(shingle) AS n_shingles FROM texts LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), both_have AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sizes
    UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, n_shingles, min(other) AS component_id FROM sizes JOIN reached USING (doc_id) GROUP BY 1, 2
""",
    "op11_chat": r"""
WITH marked(s) AS (SELECT '</s>[INST] ok [/INST]'),
rows AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', s FROM marked
    UNION ALL SELECT -1, 1, 'assistant', s FROM marked
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), written AS (
    SELECT *, length('<|im_start|><|im_sep|><|im_end|>') + 1
        + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')) AS n_chars
    FROM turns
), whole AS (
    SELECT conv_id, count(*) AS n_turns, sum(n_chars)::BIGINT AS formatted_chars,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                    FILTER (WHERE role = 'assistant'), '') AS learnt
    FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
       sha256(learnt) AS loss_sha256, formatted_chars FROM whole
""",
    "op12_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id
    FROM texts
), labelled AS (
    SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
    FROM labels GROUP BY doc_id
), failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(doc_id > first_id, false)} AS f
    FROM words LEFT JOIN labelled USING (doc_id)
), cells AS (
    SELECT part, f, (CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END
        || CASE WHEN f.C THEN 'C' ELSE '' END || CASE WHEN f.D THEN 'D' ELSE '' END
        || CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM failing GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, s::INT AS step, filter_order[s::INT] AS own, filter_order[1:s::INT - 1] AS earlier
    FROM orders, range(1, 6) r(s)
), judged AS (
    SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS fails_own, fails = own AS only_own,
           length(translate(fails, earlier, '')) < length(fails) AS gone
    FROM cells, steps
), counted AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT gone AND fails_own THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN gone AND fails_own THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN only_own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT gone AND fails_own THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN NOT gone AND fails_own THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
""",
}
