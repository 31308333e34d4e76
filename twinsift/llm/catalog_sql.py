"""DuckDB's SQL for the registered queries that it can express."""

from __future__ import annotations

#: A-Z and their lower case, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Scores of all documents that hold a term of an item, in DuckDB's SQL.
RANKED = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nw FROM lengths),
m AS (SELECT doc_id, 25 + (75 * n * nd) // nw AS m FROM lengths, totals),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, nd),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def groups(k: int, percent: int, more: str = "") -> str:
    """Sets of ``k``-word shingles, all pairs that share one, and who reaches whom over links."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {k} - 1], ' ') for i in range(1, len(w) - {k} + 2)]) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(other) AS component_id{more}
FROM sets JOIN reached USING (doc_id) GROUP BY doc_id, s
"""


#: The counts, the rates with their histograms at three levels, the limits and the verdicts.
QUALITY = r"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM texts),
named AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM named, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
counts AS (
  SELECT texts.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[\p{Lu}!]', '', 'g')) AS n_shouts, length(t) AS n_chars, len(lines) AS n_lines
  FROM texts LEFT JOIN covered ON texts.doc_id = covered.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {'symbols': n_symbols / greatest(n_words, 1), 'shouting': n_shouts / greatest(n_chars, 1), 'dup_lines': n_dup_lines / greatest(n_lines, 1),
     'repeats': n_repeat_words / greatest(n_words, 1), 'word_length': word_chars / greatest(n_words, 1)} AS r FROM counts),
rates AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'shouting', 'dup_lines', 'repeats', 'word_length']) AS rate,
    unnest([r.symbols, r.shouting, r.dup_lines, r.repeats, r.word_length]) AS x, unnest([0.3, 0.1, 0.5, 0.4, 1.25])::DOUBLE AS slack FROM judged),
levels AS (
  SELECT 2 AS level, lang, source, rate, slack, x FROM rates WHERE NOT base_failed
  UNION ALL SELECT 1, lang, NULL, rate, slack, x FROM rates WHERE NOT base_failed
  UNION ALL SELECT 0, NULL, NULL, rate, slack, x FROM rates WHERE NOT base_failed),
buckets AS (
  SELECT level, lang, source, rate, slack, floor(ln(1 + x) * 200) AS bucket, count(*) AS n FROM levels GROUP BY ALL),
sketches AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total,
    sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto FROM buckets),
quantiles AS (
  SELECT level, lang, source, rate, slack, max(total) AS total, exp((min(bucket) FILTER (WHERE upto >= total * 0.1) + 1) / 200) - 1 AS q10,
    exp((min(bucket) FILTER (WHERE upto >= total * 0.5) + 1) / 200) - 1 AS q50 FROM sketches GROUP BY ALL),
limits AS (
  SELECT level, lang, source, rate, total, q50 + greatest(5 * (q50 - q10), slack) AS high,
    CASE WHEN rate = 'word_length' THEN q50 - greatest(5 * (q50 - q10), slack) ELSE '-infinity'::DOUBLE END AS low FROM quantiles),
chosen AS (
  SELECT own.lang, own.source, own.rate, CASE WHEN own.total >= 100 THEN own.low WHEN l.total >= 100 THEN l.low ELSE e.low END AS low,
    CASE WHEN own.total >= 100 THEN own.high WHEN l.total >= 100 THEN l.high ELSE e.high END AS high
  FROM limits own JOIN limits l ON l.level = 1 AND own.lang IS NOT DISTINCT FROM l.lang AND own.rate = l.rate
    JOIN limits e ON e.level = 0 AND own.rate = e.rate WHERE own.level = 2),
fine AS (
  SELECT doc_id, bool_and(x BETWEEN low AND high) AS fine FROM rates JOIN chosen
    ON rates.lang IS NOT DISTINCT FROM chosen.lang AND rates.source IS NOT DISTINCT FROM chosen.source AND rates.rate = chosen.rate GROUP BY doc_id)
SELECT judged.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, false) AS kept
FROM judged LEFT JOIN fine ON judged.doc_id = fine.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_adaptive_quality": QUALITY,
        "op6_jaccard_groups": groups(3, 90),
        "op11_super_minhash": groups(4, 80, ", doc_id = min(other) AS kept"),
        "op12_geometric_search": RANKED,
    }
