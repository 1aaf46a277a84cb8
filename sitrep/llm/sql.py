"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from sitrep.llm import licenses as L
from sitrep.llm import quality_rules as Q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rule(rule: Q.Rule) -> str:
    ratio = f"({rule.numerator} / greatest({rule.denominator}, 1))"
    tests = []
    if rule.low is not None:
        tests.append(f"{ratio} < {rule.low}")
    if rule.high is not None:
        tests.append(f"{ratio} > {rule.high}")
    return "(" + " OR ".join(tests) + ")"


def quality_rules() -> str:
    stop = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(Q.STOP_WORDS))
    failed = ", ".join(f"CASE WHEN {_rule(r)} THEN '{r.name}' END" for r in Q.RULES)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep)
  GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN cov USING (doc_id)
), v AS (
  SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         concat_ws(',', {failed}) AS failed_rules
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM v"""


def license_scan() -> str:
    """Sentences between line or sentence ends, those with ends of their own put together again;
    then the rules one after another, each on what those before it have left."""
    known = ", ".join(
        f"('{L.normalised(s).replace(L.HOLDER, '%')}', '{i}', {L.n_parts(s)})" for i, s in L.SENTENCES.items()
    )
    most = max(map(L.n_parts, L.SENTENCES.values()))
    pieces = "\n  UNION ALL ".join(
        f"SELECT doc_id, pos, {k} AS parts, "
        + " || ' ' || ".join(["sentence", *[f"lead(sentence, {j}) OVER w" for j in range(1, k)]])
        + " AS sentence FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
        for k in range(1, most + 1)
    )
    places = ", ".join(f"({k}, '{n}')" for k, (n, _) in enumerate(L.RULES))
    left, hits = "SELECT doc_id, '<' || replace(ids, ',', '><') || '>' AS r0 FROM f", []
    for k, (_, sequence) in enumerate(L.RULES):
        row = "".join(f"<{x}>" for x in sequence)
        left = f"SELECT *, replace(r{k}, '{row}', '<>') AS r{k + 1} FROM ({left})"
        hits.append(f"CASE WHEN contains(r{k}, '{row}') THEN {k} END")
    return rf"""
WITH known(sentence, id, parts) AS (VALUES {known}), rules(place, license) AS (VALUES {places}),
s AS (
  SELECT doc_id, pos, trim(regexp_replace(translate(piece, '{L.UPPER}', '{L.LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS sentence
  FROM (SELECT doc_id, unnest(ls) AS piece, generate_subscripts(ls, 1) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS ls
    FROM documents))
), t AS (
  {pieces}
), f AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids FROM (
    SELECT t.*, id FROM t JOIN known USING (sentence, parts)
    UNION ALL SELECT doc_id, pos, parts, sentence, arg_max(id, size) FROM (
      SELECT t.*, id, length(known.sentence) AS size FROM t JOIN known ON t.parts = known.parts
        AND t.sentence LIKE known.sentence AND contains(known.sentence, '%')) GROUP BY ALL)
  GROUP BY doc_id
), m AS (
  SELECT doc_id, license, min(place) AS place
  FROM (SELECT doc_id, unnest([{', '.join(hits)}]) AS place FROM ({left})) JOIN rules USING (place) GROUP BY ALL
), l AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY place) AS licenses, count(*) AS n FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(f.n, 0) AS n_known, coalesce(f.ids, '') AS sentence_ids,
       coalesce(l.licenses, '') AS licenses, coalesce(l.n, 0) AS n_licenses
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)"""


def jaccard_join() -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r
), m AS (
  SELECT id, min(r) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id"""


def embedding_dedup() -> str:
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.98
), reach(id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r
), m AS (
  SELECT id, min(r) AS component_id FROM reach GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id"""


def suffix_dedup() -> str:
    return """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS i
        FROM (SELECT doc_id, list_transform(range(0, length(h) // 2 - 99), lambda i: md5_number(h[2 * i + 1:2 * i + 200])) AS gs FROM d))
), f AS (
  SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 100 AS fresh FROM s WHERE k > 1
), r AS (
  SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi
  FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run
), p AS (
  SELECT doc_id, lo, hi, substr(h, 2 * prev + 1, 2 * (lo - prev)) AS piece
  FROM (SELECT r.*, h, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM r JOIN d USING (doc_id))
), c AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last,
         string_agg(piece, '' ORDER BY lo) AS head
  FROM p GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE coalesce(head, '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""


def _crc32(ascii_text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    codes = f"list_transform(range(1, length({ascii_text}) + 1), lambda i: ascii(substr({ascii_text}, i, 1))::BIGINT)"
    byte = "list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda acc, b: {byte}), 4294967295)"


def repair_conversations() -> str:
    """All edits row by row: for each conversation and state the cheapest, then least, way so far."""
    return rf"""
WITH RECURSIVE k0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), k1 AS (
  SELECT *, {_crc32("key")} % 20 AS k FROM k0
), dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k1 WHERE k <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM dam
), f AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM n
), g AS (
  SELECT *, NOT blank AND NOT dup AND cut AS trunc FROM f
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), ins(s, s2, made) AS (
  VALUES (0, 0, []::VARCHAR[]), (1, 1, []), (2, 2, []), (3, 3, []), (0, 2, ['user:']), (1, 2, ['user:']),
         (3, 2, ['user:']), (2, 3, ['assistant:']), (0, 3, ['user:', 'assistant:']), (1, 3, ['user:', 'assistant:'])
), follows(s2, r, t) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), edits AS (
  SELECT conv_id, i, s2, s2 AS t, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS made FROM g, range(4) AS x(s2)
  UNION ALL
  SELECT conv_id, i, s2, t, 5 * trunc::INT, 'K', [role || ':' || text] FROM g JOIN follows USING (r) WHERE NOT blank AND NOT dup
  UNION ALL
  SELECT conv_id, i, s2, t, 1 + 5 * trunc::INT, 'R', [x.role || ':' || text]
  FROM g, (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')) AS x(s2, t, role)
  WHERE NOT blank AND NOT dup
), ways(conv_id, i, s, cost, audit, made) AS (
  SELECT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', []::VARCHAR[] FROM ids
  UNION ALL
  SELECT conv_id, i, t, b.cost, b.audit, b.made FROM (
    SELECT w.conv_id, e.i, e.t::BIGINT AS t,
           min({{'cost': w.cost + 5 * len(ins.made) + e.cost, 'audit': w.audit || repeat('I', len(ins.made)) || e.letter,
                'made': w.made || ins.made || e.made}}) AS b
    FROM ways w JOIN ins ON ins.s = w.s
    JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.s2 = ins.s2
    GROUP BY w.conv_id, e.i, e.t
  )
), c AS (
  SELECT ids.conv_id, count(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN g ON ids.conv_id IS NOT DISTINCT FROM g.conv_id GROUP BY ids.conv_id
), best AS (
  SELECT w.conv_id, min({{'cost': w.cost + 5 * len(ins.made), 'audit': w.audit || repeat('I', len(ins.made)),
                         'made': w.made || ins.made}}) AS b
  FROM ways w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
  JOIN ins ON ins.s = w.s AND ins.s2 IN (0, 3) GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, blank, duplicate, truncated, illegal, b.cost::BIGINT AS cost,
       b.audit AS audit, sha256(array_to_string(b.made, chr(10))) AS repaired_sha256
FROM c JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id"""


def prefix_trie() -> str:
    return rf"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), t AS (
  SELECT c.conv_id, 0 AS mine, n, role, text FROM c JOIN own ON own.conv_id = base AND n <= h
  UNION ALL
  SELECT c.conv_id, 1, n, role, text FROM c JOIN own ON own.conv_id = c.conv_id AND n > h
), d AS (
  SELECT conv_id, row_number() OVER w AS depth, len({WORDS}) AS words,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY mine, n ROWS UNBOUNDED PRECEDING)
), p AS (
  SELECT conv_id, depth, words, path FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c
), l AS (
  SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id
), e AS (
  SELECT path, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids
  FROM p JOIN l ON l.conv_id = p.conv_id AND length = depth GROUP BY path
), x AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saves
  FROM p GROUP BY path, depth
), k AS (
  SELECT path[:-65] AS path, count(*) AS n_children FROM x WHERE depth > 0 GROUP BY 1
), s AS (
  SELECT x.path, sum(y.saves)::BIGINT AS saved_tokens, count(*) FILTER (k.path IS NULL) AS n_leaves
  FROM x JOIN x y ON starts_with(y.path, x.path) LEFT JOIN k ON k.path = y.path GROUP BY x.path
)
SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM x JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path)
LEFT JOIN x up ON x.depth > 0 AND up.path = x.path[:-65]"""


def warc_round_trip() -> str:
    return r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""


def oracle_sql() -> dict[str, str]:
    """Queries that train a model, draw at random or call a tokenizer have none."""
    return {
        "op1_license_scan": license_scan(),
        "op2_quality_rules": quality_rules(),
        "op3_jaccard_join": jaccard_join(),
        "op5_embedding_dedup": embedding_dedup(),
        "op10_suffix_dedup": suffix_dedup(),
        "op11_repair_conversations": repair_conversations(),
        "op12_prefix_trie": prefix_trie(),
        "op13_warc_round_trip": warc_round_trip(),
    }
