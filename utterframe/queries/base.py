"""The word timeline of the conversations, and the SQL of the frames that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterframe.durable import durable
from utterframe.operators import detect, intervals, sequence
from utterframe.params import PARAMS
from utterframe.queries import table

#: Columns of the words as the queries return them.
P = PARAMS


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.timeline(table(spark, sf_dir, "conversations"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline as a cut of lineage, for plans that read it several times: it is laid out once."""
    return durable(words(spark, sf_dir))


def cuts(w: DataFrame) -> DataFrame:
    """Edits of three detectors, overlapping as they come."""
    return detect.leading_filler(w).unionByName(detect.stutter(w)).unionByName(detect.consecutive_filler(w))


def numbered(edits: DataFrame) -> DataFrame:
    """Edits with an index in their recording."""
    order = sequence.order("start_ms", "end_ms", "type", "w_from")
    return edits.withColumn("edit_id", (F.row_number().over(order) - 1).cast("bigint"))


def segments(w: DataFrame) -> DataFrame:
    """The cuts merged, with an index in their recording."""
    m = intervals.merge(cuts(w))
    return m.withColumn("seg_id", (F.row_number().over(sequence.order("start_ms")) - 1).cast("bigint")).select("rec_id", "seg_id", "start_ms", "end_ms")


def quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


# The frames in DuckDB, as common table expressions in the order of their use.
TL = r"""WITH t1 AS (SELECT conv_id AS rec_id, turn, role AS speaker, string_split_regex(text, '\s+') AS l FROM conversations),
t2 AS (SELECT rec_id, turn, speaker, l, unnest(range(len(l))) AS pos FROM t1),
t3 AS (SELECT rec_id, turn, speaker, pos, l[pos + 1] AS raw, lower(regexp_replace(l[pos + 1], '[^\p{L}\p{N}]+', '', 'g')) AS tok FROM t2),
t4 AS (SELECT *, 60 * length(tok) + 40 AS dur, CASE WHEN regexp_matches(raw, '[.!?]$') THEN 900 WHEN regexp_matches(raw, ',$') THEN 250 ELSE 40 END AS pause,
  CASE WHEN lag(speaker) OVER v <> speaker THEN 1200 ELSE 0 END AS wait, coalesce(regexp_matches(lag(raw) OVER v, '[.!?]$') OR lag(speaker) OVER v <> speaker, true) AS fresh,
  row_number() OVER v - 1 AS word_idx FROM t3 WHERE tok <> '' WINDOW v AS (PARTITION BY rec_id ORDER BY turn, pos)),
t5 AS (SELECT *, (sum(dur + pause + wait) OVER v - dur - pause)::BIGINT AS start_ms, (sum(fresh::INT) OVER v - 1)::BIGINT AS sent_idx FROM t4 WINDOW v AS (PARTITION BY rec_id ORDER BY turn, pos)),
w AS (SELECT rec_id, word_idx, turn, raw, tok, speaker, start_ms, start_ms + dur AS end_ms, sent_idx FROM t5),
s AS (SELECT rec_id, sent_idx, min(word_idx) AS w_start, max(word_idx) AS w_end, arg_min(speaker, word_idx) AS speaker, string_agg(tok, ' ' ORDER BY word_idx) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM w GROUP BY rec_id, sent_idx),
g AS (SELECT rec_id, word_idx AS next_word, reach AS gap_start, start_ms AS gap_end, start_ms - reach AS gap_ms, sent_idx FROM
  (SELECT *, max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w) WHERE start_ms - reach >= 500),
pw AS (SELECT *, row_number() OVER v - 1 AS i, count(*) OVER (PARTITION BY rec_id, sent_idx) AS n, lag(tok) OVER v AS before, lead(tok) OVER v AS after FROM w WINDOW v AS (PARTITION BY rec_id, sent_idx ORDER BY word_idx))"""

RUNS = """, r1 AS (SELECT *, sum((before IS NOT NULL AND before <> tok)::INT) OVER (PARTITION BY rec_id, sent_idx ORDER BY word_idx) AS run FROM pw),
r AS (SELECT rec_id, sent_idx, tok, min(word_idx) AS w_from, max(word_idx) AS w_to, count(*) AS run_len, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(i) AS i FROM r1 GROUP BY rec_id, sent_idx, run, tok HAVING count(*) >= 2)"""

D2 = f""", d2 AS (SELECT r.rec_id, r.sent_idx, 'stutter' AS type, w.word_idx AS w_from, w.word_idx AS w_to, w.start_ms, w.end_ms,
  run_len = 2 AND r.tok IN ({quoted(P.high_frequency)}) AS needs_review, CASE WHEN run_len = 2 AND r.tok IN ({quoted(P.high_frequency)}) THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence
  FROM r JOIN w ON w.rec_id = r.rec_id AND w.word_idx >= r.w_from AND w.word_idx < r.w_to
  WHERE r.tok || r.tok NOT IN ({quoted(P.reduplicated)}) AND NOT regexp_matches(r.tok, '^\\p{{N}}+$') AND NOT (run_len = 2 AND length(r.tok) = 1 AND r.i > 0))"""

D0 = f""", h AS (SELECT rec_id, sent_idx, list(tok ORDER BY word_idx) AS toks, list(word_idx ORDER BY word_idx) AS ix, list(start_ms ORDER BY word_idx) AS st, list(end_ms ORDER BY word_idx) AS en, count(*) AS n FROM w GROUP BY rec_id, sent_idx),
h1 AS (SELECT *, CASE WHEN array_to_string(toks[1:3], '') IN ({quoted(P.fillers3)}) AND n > 3 THEN 3 WHEN array_to_string(toks[1:2], '') IN ({quoted(P.fillers2)}) AND n > 2 THEN 2 WHEN toks[1] IN ({quoted([*P.fillers, *P.ambiguous])}) THEN 1 END AS k FROM h WHERE n >= 2),
d0 AS (SELECT rec_id, sent_idx, 'filler_start' AS type, ix[1] AS w_from, ix[k] AS w_to, st[1] AS start_ms, en[k] AS end_ms, k = 1 AND toks[1] NOT IN ({quoted(P.fillers)}) AS needs_review,
  CASE WHEN k = 1 AND toks[1] NOT IN ({quoted(P.fillers)}) THEN 0.8 ELSE 0.95 END::DOUBLE AS confidence FROM h1 WHERE k IS NOT NULL AND length(array_to_string(toks[k + 1:], '')) >= 2)"""

D6 = f""", f1 AS (SELECT *, tok IN ({quoted([*P.fillers, *P.ambiguous, *P.mid_fillers])}) AS f FROM pw),
f2 AS (SELECT *, sum((pf IS NOT NULL AND pf <> f)::INT) OVER (PARTITION BY rec_id, sent_idx ORDER BY word_idx) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY rec_id, sent_idx ORDER BY word_idx) AS pf FROM f1)),
f3 AS (SELECT *, lead(tok) OVER (PARTITION BY rec_id, sent_idx, run ORDER BY word_idx) AS nx FROM f2 WHERE f),
d6 AS (SELECT rec_id, sent_idx, 'consecutive_filler' AS type, min(word_idx) FILTER (nx <> tok) AS w_from, max(word_idx) AS w_to, min(start_ms) FILTER (nx <> tok) AS start_ms, max(end_ms) AS end_ms, false AS needs_review, 0.95::DOUBLE AS confidence
  FROM f3 GROUP BY rec_id, sent_idx, run HAVING count(*) FILTER (nx <> tok) > 0)"""

CUTS = TL + RUNS + D2 + D0 + D6 + """, cut AS (SELECT * FROM d0 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d6)"""

MERGED = CUTS + """, m1 AS (SELECT *, max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cut),
m2 AS (SELECT *, sum((reach IS NOT NULL AND start_ms > reach + 10)::INT) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS run FROM m1),
m AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY min(start_ms)) - 1 AS seg_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM m2 GROUP BY rec_id, run)"""

EDIT = "rec_id, sent_idx, type, w_from, w_to, start_ms, end_ms, needs_review, confidence"
