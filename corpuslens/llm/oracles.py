"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from corpuslens.llm import quality_rules as Q

LINE_CHUNKS = r"""
WITH docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, i, len(a) AS n, a[i + 1] AS line FROM (SELECT doc_id, a, unnest(range(0, len(a))) AS i FROM docs)),
marked AS (SELECT doc_id, i, n, line, length(line) - length(replace(line, ' ', '')) >= 49 AS long,
  md5(coalesce(lag(line) OVER w || chr(10), '') || line) AS rolled FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ends AS (SELECT doc_id, n, i AS last FROM (SELECT *, coalesce(lead(long) OVER (PARTITION BY doc_id ORDER BY i), false) AS next_long FROM marked)
  WHERE i = n - 1 OR long OR next_long OR regexp_matches(rolled, '^[0-3]')),
spans AS (SELECT doc_id, n, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY last) + 1, 0) AS first, last FROM ends
  UNION SELECT doc_id, n, 0, n - 1 FROM ends),
chunks AS (SELECT s.doc_id, s.first, s.last - s.first + 1 AS n_lines, n, array_to_string(a[s.first + 1 : s.last + 1], chr(10)) AS t
  FROM spans s JOIN docs USING (doc_id)),
worth AS (SELECT * FROM (SELECT *, length(t) - length(replace(t, ' ', '')) AS blanks FROM chunks)
  WHERE regexp_matches(t, '[^\x20\x09-\x0D]') AND (n_lines = n OR (n_lines > 1 AND blanks + n_lines >= 10) OR (n_lines = 1 AND blanks >= 49))),
gone AS (SELECT doc_id, first, n_lines FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, first, n_lines) AS k FROM worth) WHERE k > 1),
counted AS (SELECT doc_id, count(*)::INTEGER AS n_removed FROM gone GROUP BY doc_id),
left_over AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) AS rest FROM lines l JOIN counted USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND l.i >= g.first AND l.i < g.first + g.n_lines) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN coalesce(rest, '') ELSE text END AS text, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM docs d LEFT JOIN counted USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

_VALUES = """CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
  greatest(0, CASE WHEN n_words > 0 THEN (n_words - n_distinct) / n_words ELSE 0 END - 0.5) AS same_word_share"""
_GRID = ", ".join(f"('{name}', {i + 1}, {c}::DOUBLE)" for name, cuts in Q.GRID.items() for i, c in enumerate(cuts))
_TRIED = sum(map(len, Q.GRID.values()))
_RISK = Q.RISK / len(Q.GRID)

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM docs)),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, sum(least(5, coalesce(i - before, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM starts) GROUP BY doc_id),
stats AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(l) AS n_lines, len(list_distinct(w)) AS n_distinct, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM docs LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_VALUES} FROM stats),
good AS (SELECT doc_id, avg(quality) >= 0.5 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
long AS (UNPIVOT (SELECT doc_id, lang, symbol_share::DOUBLE AS symbol_share, dup_line_share::DOUBLE AS dup_line_share, repeat_share::DOUBLE AS repeat_share,
  same_word_share::DOUBLE AS same_word_share FROM judged WHERE NOT base_failed) ON symbol_share, dup_line_share, repeat_share, same_word_share INTO NAME rule VALUE v),
grid AS (SELECT * FROM (VALUES {_GRID}) g(rule, step, cutoff)),
held AS (SELECT long.*, good FROM long JOIN good USING (doc_id)),
tried AS (SELECT lang, h.rule, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
  count(*) FILTER (good AND v > cutoff) AS good_over, count(*) FILTER (NOT good AND v > cutoff) AS bad_over FROM held h JOIN grid USING (rule) GROUP BY ALL),
strata AS (SELECT lang, max(n_good) AS n FROM tried GROUP BY lang),
tails AS (SELECT lang, j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RISK}) + (n - j) * ln(1 - {_RISK}))) OVER (PARTITION BY lang ORDER BY j) AS p
  FROM (SELECT lang, n, unnest(range(0, ceil(n * {_RISK})::BIGINT + 1)) AS j FROM strata WHERE n > 0)),
allowed AS (SELECT lang, max(j) AS k FROM tails WHERE p <= {Q.DELTA} / (SELECT count(*) * {_TRIED} FROM strata) GROUP BY lang),
chosen AS (SELECT t.lang, rule, cutoff FROM tried t JOIN allowed a ON t.lang IS NOT DISTINCT FROM a.lang WHERE good_over <= k AND bad_over > good_over
  QUALIFY row_number() OVER (PARTITION BY t.lang, rule ORDER BY bad_over - good_over DESC, cutoff DESC) = 1),
over AS (SELECT DISTINCT l.doc_id FROM long l JOIN chosen c ON l.rule = c.rule AND l.lang IS NOT DISTINCT FROM c.lang WHERE v > cutoff)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.doc_id IS NULL AS kept
FROM judged j LEFT JOIN over o ON j.doc_id = o.doc_id"""

HARD_NEGATIVES = """
WITH rows AS (SELECT row_number() OVER () AS own, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.own, a.vec_id AS anchor_id, b.own AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.own <> b.own AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INTEGER AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.own = n.own AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.own, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST)
QUALIFY row_number() OVER w <= 5"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return f"sha256({' || '.join(map(_field, fields))})"


#: The checksum of an id's digits, a bit at a time: each byte enters before its eight shifts.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))))"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE told AS (SELECT *, CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS said FROM documents),
leaves AS (SELECT doc_id, lang, leaf, claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("said")} AS claimed FROM told)),
tree AS (SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, i // 2),
tops AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM tree WHERE n = 1),
over_tree AS (SELECT 0 AS level, i, h, count(*) OVER () AS n FROM tops
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM over_tree WHERE n > 1 GROUP BY level, i // 2),
root AS (SELECT h AS root FROM over_tree WHERE n = 1),
above AS (SELECT t.lang, t.h AS subroot, list(struct_pack(right_of := (t.i >> o.level) % 2 = 1, s := s.h) ORDER BY o.level) FILTER (o.level IS NOT NULL) AS up
  FROM tops t LEFT JOIN over_tree o ON o.n > 1 AND o.i = t.i >> o.level
  LEFT JOIN over_tree s ON s.level = o.level AND s.i = xor(o.i, 1) GROUP BY t.lang, t.h),
own AS (SELECT l.lang, l.i, list(struct_pack(right_of := (l.i >> o.level) % 2 = 1, s := s.h) ORDER BY o.level) FILTER (o.level IS NOT NULL) AS up
  FROM leaves l LEFT JOIN tree o ON o.lang IS NOT DISTINCT FROM l.lang AND o.n > 1 AND o.i = l.i >> o.level
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = o.level AND s.i = xor(o.i, 1) GROUP BY l.lang, l.i),
proofs AS (SELECT doc_id, leaf, claimed, subroot, list_concat(coalesce(o.up, []), coalesce(a.up, [])) AS up FROM leaves l
  JOIN own o ON o.i = l.i AND o.lang IS NOT DISTINCT FROM l.lang JOIN above a ON a.lang IS NOT DISTINCT FROM l.lang),
folds AS (SELECT *, list_reduce(list_prepend(claimed, list_transform(up, lambda x: CASE WHEN x.s IS NULL THEN 'n' WHEN x.right_of THEN 'l' || x.s ELSE 'r' || x.s END)),
  lambda acc, x: sha256(CASE WHEN x[1] = 'n' THEN acc WHEN x[1] = 'l' THEN x[2:] || acc ELSE acc || x[2:] END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_filter(list_transform(up, lambda x: x.s), lambda s: s IS NOT NULL), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folds, root"""

ORACLES = {"op6_quality_rules": QUALITY_RULES, "op8_line_chunks": LINE_CHUNKS, "op11_hard_negatives": HARD_NEGATIVES,
           "op12_merkle_manifest": MERKLE_MANIFEST}
