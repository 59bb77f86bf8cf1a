"""The queries of the language-model data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from . import conversation_repair, exact, language_model, minhash, packing, pages, pieces, quality, rules, sharding, toxicity, vectors, whitening

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_html_extraction": pages.op5_html_extraction,
    "op6_sharding": sharding.op6_sharding,
    "op7_lm_scoring": language_model.op7_lm_scoring,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_embedding_near_dedup": vectors.op10_embedding_near_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_exact_dedup": exact.op13_exact_dedup,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: From nodes (id) and links (a, b), both ways round: the smallest id that each reaches.
_REACHED = "reached(id, c) AS (SELECT id, id FROM nodes UNION SELECT b, c FROM reached JOIN links ON id = a), components AS (SELECT id, min(c) AS c FROM reached GROUP BY 1)"


def _worse(best: str, cost: int, letter: str) -> str:
    """A best way so far (nine digits of its cost, then its letters) with one more edit; null stays null."""
    return f"(lpad((substr({best}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({best}, 10) || '{letter}')"


def _inserted(columns: str) -> str:
    """The best ways (e, s, u, a) to each state, with turns inserted where that is cheaper."""
    u = f"least(u, {_worse('least(e, s, a)', 3, 'I')})"
    return f"SELECT {columns}, e, s, {u} AS u, least(a, {_worse(u, 3, 'I')}) AS a"


def _row(own: str, kept: str, made: str | None, initial: str) -> str:
    """The best way to a state after a row, from those before it: by deletion, by keeping it, by another role."""
    ways = [_worse(own, 4, "D"), f"CASE WHEN free AND initial = '{initial}' THEN CASE WHEN cut THEN {_worse(kept, 3, 'K')} ELSE {_worse(kept, 0, 'K')} END END"]
    if made:
        ways.append(f"CASE WHEN free THEN CASE WHEN cut THEN {_worse(made, 6, 'R')} ELSE {_worse(made, 3, 'R')} END END")
    return f"least({', '.join(ways)})"


_SPACES = "E' \\t\\n\\x0b\\x0c\\r'"
#: A crc32 from its table, a damage by it, faults by windows; then a row at a time the best ways to the four states, and the audit's letters one by one.
_REPAIR = f"""
        WITH RECURSIVE shifted(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM shifted WHERE k < 8),
        bytes AS (SELECT list(c ORDER BY i) AS t FROM shifted WHERE k = 8),
        crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 20 AS kind FROM conversations, bytes),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text FROM crc, range(2) copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
        numbered AS (SELECT coalesce(conv_id::VARCHAR, '') AS id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {_SPACES}) AS bare FROM damaged),
        told AS (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY id ORDER BY i) AS before FROM numbered),
        turns AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, fault NOT IN ('blank', 'duplicate') AS free, fault = 'truncated' AS cut FROM told),
        counted AS (SELECT id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(cut) AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY id),
        ways(id, i, e, s, u, a) AS (
            {_inserted("id, 0::BIGINT AS i")} FROM (SELECT id, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM counted)
            UNION ALL
            {_inserted("id, i")} FROM (SELECT t.id, t.i, {_worse("e", 4, "D")} AS e, {_row("s", "e", None, "s")} AS s, {_row("u", "least(e, s, a)", "least(e, s, a)", "u")} AS u, {_row("a", "u", "u", "a")} AS a FROM ways w JOIN turns t ON t.id = w.id AND t.i = w.i + 1)),
        audits AS (SELECT c.*, substr(least(e, a), 1, 9)::BIGINT AS cost, substr(least(e, a), 10) AS audit FROM counted c JOIN ways w ON w.id = c.id AND w.i = c.n),
        walked(id, audit, p, i, state, said) AS (
            SELECT id, audit, 0, 0::BIGINT, 'e', NULL::VARCHAR FROM audits
            UNION ALL
            SELECT w.id, w.audit, p + 1, w.i + (letter <> 'I')::BIGINT, CASE letter WHEN 'D' THEN state WHEN 'K' THEN t.initial ELSE made[1] END,
                CASE WHEN letter = 'D' THEN said ELSE coalesce(said || chr(10), '') || CASE letter WHEN 'I' THEN made || ':' WHEN 'K' THEN t.role || ':' || t.text ELSE made || ':' || t.text END END
            FROM (SELECT *, substr(audit, p + 1, 1) AS letter, CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS made FROM walked WHERE p < length(audit)) w LEFT JOIN turns t ON t.id = w.id AND t.i = w.i + 1),
        repaired AS (SELECT id, said FROM walked WHERE p = length(audit))
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN audits ON audits.id = coalesce(c.conv_id::VARCHAR, '') LEFT JOIN repaired USING (id)"""
#: Every pair is compared, so these are for small tables.
SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE words AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
        nodes AS (SELECT id, len(s) AS n FROM sets),
        flat AS (SELECT id, unnest(s) AS s FROM sets),
        common AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM flat x JOIN flat y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
        {_REACHED}
        SELECT nodes.id AS doc_id, n AS n_shingles, c AS component_id, nodes.id = c AS kept FROM nodes JOIN components USING (id)""",
    "op10_embedding_near_dedup": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
        whole AS (SELECT * FROM nodes WHERE v IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        links AS (SELECT x.id AS a, y.id AS b FROM whole x JOIN whole y ON x.label = y.label AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
        {_REACHED}
        SELECT nodes.id AS vec_id, (SELECT count(*) FROM links WHERE a = nodes.id) AS n_links, c AS component_id, nodes.id = c AS kept FROM nodes JOIN components USING (id)""",
    "op11_conversation_repair": _REPAIR,
    "op13_exact_dedup": f"""
        WITH digests AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM digests WINDOW w AS (PARTITION BY text_sha256)""",
}
