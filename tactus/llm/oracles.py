"""SQL twins of the queries that SQL can state over whole tables."""

from __future__ import annotations

#: Words of a text: runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7 = f"""WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
  bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
  ws AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
  ps AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM dw, (SELECT DISTINCT k FROM ws) WHERE len(w) >= k)),
  h AS (SELECT doc_id, item, i, k FROM ps JOIN ws USING (k, s)),
  hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
  hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

OP9 = f"""WITH RECURSIVE dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM dw WHERE len(w) > 0)),
  sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  lk AS (SELECT x, y, c = p.n AND c = q.n AS same FROM pr JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)),
  cc AS (SELECT doc_id, doc_id AS m FROM dw UNION SELECT lk.x, cc.m FROM cc JOIN lk ON lk.y = cc.doc_id),
  cl AS (SELECT doc_id, min(m) AS class_id FROM cc GROUP BY 1)
  SELECT cl.doc_id, class_id, count(y)::BIGINT AS n_links, least(cl.doc_id, min(y) FILTER (same)) AS copy_id FROM cl LEFT JOIN lk ON x = cl.doc_id GROUP BY 1, 2"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  g AS (SELECT lang, n, array_to_string(w[i + 1:i + n], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, n, unnest(range(len(w) - n + 1)) AS i FROM w, (SELECT unnest(range(1, 5)) AS n) WHERE len(w) >= n) GROUP BY ALL HAVING count(*) >= 30),
  t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
  c AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE n > 1),
  k AS (SELECT lang, phrase, a, array_to_string(w[1:k], ' ') AS h, array_to_string(w[k + 1:n], ' ') AS e, k FROM (SELECT *, unnest(range(1, n)) AS k FROM c)),
  s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM k JOIN g x ON x.lang = k.lang AND x.phrase = h JOIN g y ON y.lang = k.lang AND y.phrase = e
    QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1),
  i AS (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, w, a, n, m, unnest(range(1, n - m + 2)) AS b FROM (SELECT *, unnest(range(2, n)) AS m FROM c WHERE n > 2)) GROUP BY 1, 2),
  o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a)
  SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000"""


def _codes(rounds: int = 4) -> str:
    """Codebooks of each round as tables b0, b1, ...: part, entry, position and value."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"d{k} AS (SELECT vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} b ON b.part = x.part AND b.pos = x.pos GROUP BY 1, 2, 3)")
        steps.append(f"a{k} AS (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM d{k} GROUP BY 1, 2)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT part, entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{k} USING (vec_id, part) GROUP BY 1, 2, 3)")
            steps.append(f"b{k + 1} AS (SELECT part, entry, pos, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry, pos))")
    return ",\n  ".join(steps)


OP12 = f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  x AS (SELECT vec_id, (i // (n // 4))::INT AS part, (i % (n // 4))::INT AS pos, floor(1024 * embedding[i + 1]::DOUBLE)::BIGINT AS v FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM e)),
  b0 AS (SELECT part, entry, pos, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 256) USING (vec_id)),
  {_codes()},
  r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY 1)
  SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b4) AS codebooks_sha256
  FROM r JOIN e USING (vec_id)"""
