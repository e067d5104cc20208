"""Texts cut off before their end (problem 6), in pure SQL.

Method: word trigrams are counted inside sentences and at their ends, over all texts of a field. The final trigram of
every text without a full stop is joined to the counts; texts whose final trigram is frequent inside but almost never
last are cut. Three cases need more than the trigram itself:

* the last word was cut: it stands nowhere inside, and in the same place longer words begin with it;
* the trigram is rare (it holds a name): the counts of its last two words decide;
* the cut fell on the end of a clause: the text is exactly as long as most cut texts of its source, in characters or
  in bytes.

A written mark of the cut (… or [...]) and an end after a comma, dash or the like are proof by themselves. A text that
ends with a full stop is whole; so is one whose final trigram often ends sentences, with the full stop or without.

Texts are read twice: for the counts, and for their ends. Both results, far smaller than the texts, are written to the
shared checkpoint folder, and all else is joins of these two tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from plenarium.lineage import cut

#: A trigram seen inside at least ``SEEN`` times is known; it is "almost never last" below the share ``RARE`` of ends.
SEEN, RARE = 3, 0.05
#: A length is a source's limit if at least so many cut texts have it, and this share of the source's cut texts.
LIMIT_TEXTS, LIMIT_SHARE = 5, 0.3

# Ends are looked at without regular expressions: white space, marks of a cut, what a text does not end with by itself.
_SPACE = r"' \t\n\r\f\u000b'"
_TEXTS = f"""
WITH ended AS (SELECT part, id, source, text, trim(TRAILING {_SPACE} FROM text) AS t FROM {{records}} WHERE trim(TRAILING {_SPACE} FROM text) <> ''),
texts AS (
  SELECT part, id, source, text, endswith(t, '...') OR endswith(t, '[...]') OR endswith(t, '[…]') OR right(t, 1) IN ('…', ',', ';', ':', '(', '—', '–') AS marked,
    trim(BOTH {_SPACE} FROM left(t, char_length(t) - CASE WHEN endswith(t, '[...]') THEN 5 WHEN endswith(t, '[…]') OR endswith(t, '...') THEN 3 WHEN endswith(t, '…') THEN 1 ELSE 0 END)) AS body
  FROM ended
)"""
# Words: from the first to the last letter or digit of a run without spaces.
_WORDS = r"concat(array('^', '^'), regexp_extract_all(lower(sentence), r'[\pL\pN](?:\S*[\pL\pN])?', 0))"
_STOPPED = """right(trim(TRAILING '"”’)]' FROM sentence), 1) IN ('.', '!', '?')"""

#: Word trigrams of all sentences: how often inside, last, and last with a full stop.
TRIGRAMS = rf"""{_TEXTS},
sentences AS (SELECT explode(split(body, r'(?<=[.!?])\s+')) AS sentence FROM texts),
worded AS (SELECT {_WORDS} AS w, {_STOPPED} AS stopped FROM sentences)
SELECT w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count_if(i < n - 3) AS inside, count_if(i = n - 3) AS ends, count_if(i = n - 3 AND stopped) AS stops
FROM (SELECT w, size(w) AS n, stopped, explode(if(size(w) > 2, sequence(0, size(w) - 3), array())) AS i FROM worded)
GROUP BY 1, 2, 3
"""

#: A row per text, without the text: what its end looks like, and its last trigram where that has to decide.
TAILS = rf"""{_TEXTS},
tails AS (
  SELECT part, id, source, marked, chars, bytes, {_STOPPED} AS stopped, {_WORDS} AS w
  FROM (SELECT part, id, source, marked, char_length(text) AS chars, octet_length(text) AS bytes, regexp_extract(body, r'(?s)^(?:.*[.!?]\s+)?(.*)$', 1) AS sentence FROM texts)
)
SELECT part, id, source, marked, chars, bytes, NOT stopped AND NOT marked AND size(w) > 2 AS open,
  try_element_at(w, -3) AS w1, try_element_at(w, -2) AS w2, try_element_at(w, -1) AS w3 FROM tails
"""

#: The verdict on every text, by its end and the counts.
VERDICT = """
WITH asked AS (SELECT w1, w2, w3, count(*) AS texts FROM {tails} WHERE open GROUP BY 1, 2, 3),
bigrams AS (SELECT w2, w3, sum(inside) AS inside, sum(ends) AS ends, sum(stops) AS stops FROM {trigrams} GROUP BY 1, 2),
seen AS (SELECT a.*, t.inside, t.ends, t.stops FROM asked a JOIN {trigrams} t ON a.w1 = t.w1 AND a.w2 = t.w2 AND a.w3 = t.w3),
places AS (SELECT DISTINCT w1, w2 FROM seen WHERE inside = 0 AND stops = 0),
-- every beginning of the words in such a place, so that last words that were cut are found by equality
beginnings AS (
  SELECT DISTINCT w1, w2, substring(w3, 1, n) AS w3 FROM (
    SELECT t.w1, t.w2, t.w3, explode(if(char_length(t.w3) > 1, sequence(1, char_length(t.w3) - 1), array())) AS n
    FROM {trigrams} t LEFT SEMI JOIN places p ON t.w1 = p.w1 AND t.w2 = p.w2 WHERE t.inside + t.stops > 0)
),
judged AS (
  SELECT a.w1, a.w2, a.w3, CASE
      WHEN a.inside = 0 AND a.stops = 0 AND b.w3 IS NOT NULL THEN true
      WHEN a.inside + a.ends - a.texts >= {seen_least} THEN a.ends - least(a.texts, a.ends) + a.stops < {rare} * a.inside
        AND a.ends < greatest({rare} * a.inside, a.texts + 1)
      WHEN g.inside + g.ends - a.texts >= {seen_least} THEN g.stops < {rare} * g.inside
      ELSE a.stops = 0 AND g.stops = 0 AND a.ends < {seen_least} END AS cut
  FROM seen a JOIN bigrams g ON a.w2 = g.w2 AND a.w3 = g.w3
  LEFT JOIN beginnings b ON a.w1 = b.w1 AND a.w2 = b.w2 AND a.w3 = b.w3
),
ends AS (
  SELECT t.part, t.id, t.source, t.chars, t.bytes, t.marked, t.open, coalesce(j.cut, false) AS cut
  FROM {tails} t LEFT JOIN judged j ON t.open AND t.w1 = j.w1 AND t.w2 = j.w2 AND t.w3 = j.w3
),
lengths AS (
  SELECT source, kind, length, count(*) AS n FROM (SELECT source, stack(2, 'chars', chars, 'bytes', bytes) AS (kind, length) FROM ends WHERE open AND cut) GROUP BY 1, 2, 3
),
totals AS (SELECT source, kind, sum(n) AS cuts FROM lengths GROUP BY 1, 2),
limits AS (
  SELECT l.source, l.kind, l.length FROM lengths l JOIN totals t ON l.source = t.source AND l.kind = t.kind
  WHERE l.n >= {limit_texts} AND l.n >= {limit_share} * t.cuts
)
SELECT e.part, e.id, e.source, e.marked OR e.cut OR e.open AND (c.length IS NOT NULL OR b.length IS NOT NULL) AS cut
FROM ends e LEFT JOIN limits c ON c.kind = 'chars' AND e.source = c.source AND e.chars = c.length
LEFT JOIN limits b ON b.kind = 'bytes' AND e.source = b.source AND e.bytes = b.length
"""


def verdicts(records: DataFrame) -> DataFrame:
    """``part``, ``id``, ``source`` and ``cut`` of every non-blank text of ``records`` (columns ``part``, ``id``, ``source``,
    ``text``).

    ``id`` is unique within ``part``; ``source`` may be null (it then has no limit). Null, empty and blank texts give no
    row; repeated records are rows each; an empty table gives an empty table. Counts cover all texts."""
    session = records.sparkSession
    records = records.select("part", "id", "source", "text")
    trigrams, tails = cut(session.sql(TRIGRAMS, records=records)), cut(session.sql(TAILS, records=records))
    return session.sql(VERDICT, trigrams=trigrams, tails=tails, seen_least=SEEN, rare=RARE, limit_texts=LIMIT_TEXTS, limit_share=LIMIT_SHARE)


def truncated(records: DataFrame) -> DataFrame:
    """The cut ones of ``records``: ``part``, ``id``, ``source`` (see ``verdicts``)."""
    return verdicts(records).where("cut").drop("cut")
