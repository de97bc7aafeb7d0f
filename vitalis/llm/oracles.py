"""DuckDB SQL for the operators that SQL can express over whole tables."""

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents
), word AS (
  SELECT doc_id, pos, words[pos] AS w,
         CASE WHEN pos + 12 <= len(words) THEN array_to_string(words[pos:pos + 12], ' ') END AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM split)
), first_doc AS (
  SELECT win, min(doc_id) AS d FROM word WHERE win IS NOT NULL GROUP BY win
), judged AS (
  SELECT word.doc_id, pos, w,
         max(CASE WHEN first_doc.d < word.doc_id THEN 1 ELSE 0 END)
           OVER (PARTITION BY word.doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN first_doc USING (win)
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
         string_agg(w, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS t
  FROM judged GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM split WHERE len(words) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * i >= 75 * (x.n + y.n - i)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.id
), component AS (
  SELECT id, min(c) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id JOIN component ON component.id = d.doc_id
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.id
), component AS (
  SELECT id, min(c) AS component_id FROM reach GROUP BY id
), degree AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON component.id = vec_id LEFT JOIN degree ON degree.a = vec_id
"""

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}') AS terms
  FROM documents
), counted AS (
  SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(terms) AS t FROM doc) GROUP BY ALL
), kept AS (
  SELECT lang, t, sum(n) AS n FROM counted GROUP BY lang, t HAVING count(*) >= 10
), grp AS (
  SELECT DISTINCT lang, source FROM doc
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), cell AS (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n
  FROM grp g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, t, sum(n) AS n FROM counted GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.t = k.t
), p AS (
  SELECT cell.lang, source, t, cell.n,
         1 + (1000000000::HUGEINT * (cell.n + 2)) // (sum(cell.n) OVER (PARTITION BY cell.lang, source) + 2 * v.v) AS p
  FROM cell JOIN v ON v.lang = cell.lang
), q AS (
  SELECT kept.lang, t, 1 + (1000000000::HUGEINT * (n + 2)) // (v.total + 2 * v.v) AS q FROM kept JOIN v USING (lang)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN summed s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), term AS (
  SELECT p.lang, source, 'term' AS part, p.t AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.t = p.t WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# CRC-32 of a list of bytes by half bytes: fixed values, the sixteen remainders of the reflected polynomial EDB88320.
CRC_TABLE = ("[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, "
             "4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]")


def crc32(codes: str) -> str:
    """SQL for the CRC-32 of a list of byte values."""
    half = f"xor(c >> 4, ({CRC_TABLE})[CAST(1 + (xor(c, %s) & 15) AS BIGINT)])"
    return (f"xor(4294967295, list_reduce({codes}, lambda c, b: list_reduce([b & 15, b >> 4], "
            f"lambda c, b: {half % 'b'}, c), CAST(4294967295 AS BIGINT)))")


LETTERS = "A-Za-z\u00C0-\u00FF"
BYTES = ("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: "
         "CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END))")

OP13 = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), slipped AS (
  SELECT run, times, {crc32(BYTES)} AS h FROM run
), word AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times
        FROM slipped)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), pattern AS (
  SELECT word, n, word[:i] || '*' || word[i + 2:] AS key
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)
  UNION ALL
  SELECT word, n, word[:i] || '*' || word[i + 1:] AS key
  FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM word)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM pattern a JOIN pattern b USING (key) WHERE a.word <> b.word
), best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS form, max(m) AS m FROM near GROUP BY ALL
), formed AS (
  SELECT word.word, CASE WHEN m >= 10 * word.n THEN form END AS form, word.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN m >= 10 * word.n THEN m END AS form_n
  FROM word LEFT JOIN best ON best.word = word.word
), chain(word, here, step) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL
  SELECT chain.word, form, step + 1 FROM chain JOIN formed ON formed.word = chain.here WHERE form IS NOT NULL
)
SELECT formed.word, form, last.root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed JOIN (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word) last ON last.word = formed.word
"""
