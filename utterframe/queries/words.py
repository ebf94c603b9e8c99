"""Timeline, folds, gaps, intervals and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from utterframe.durable import durable
from utterframe.operators import audit, detect, evaluate, intervals, resolve, sequence
from utterframe.plans import cut_analysis
from utterframe.queries import query
from utterframe.queries.base import CUTS, D0, D2, D6, EDIT, MERGED, RUNS, TL, P, cuts, numbered, quoted, segments, stored, words


@query(TL + " SELECT rec_id, word_idx, tok, speaker, start_ms, end_ms, sent_idx FROM w")
def word_timeline(spark, sf_dir):
    return words(spark, sf_dir).select("rec_id", "word_idx", "tok", "speaker", "start_ms", "end_ms", "sent_idx")


@query(TL + " SELECT * FROM s")
def sentence_fold(spark, sf_dir):
    return sequence.sentences(words(spark, sf_dir))


@query(TL + " SELECT speaker, count(*) AS n_words, (count(*) * 10000 // (SELECT count(*) FROM w))::BIGINT AS share_bp FROM w GROUP BY speaker")
def speaker_stats(spark, sf_dir):
    return sequence.speaker_stats(words(spark, sf_dir))


@query(TL + " SELECT rec_id, speaker, k, sent_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, speaker ORDER BY sent_idx) AS k FROM s) WHERE k <= 5")
def sentence_preview_topk(spark, sf_dir):
    return sequence.first_sentences(sequence.sentences(words(spark, sf_dir)))


@query(TL + " SELECT * FROM g")
def gap_rows(spark, sf_dir):
    return sequence.gaps(words(spark, sf_dir))


@query(TL + " SELECT CASE WHEN gap_ms < 1000 THEN 'short' WHEN gap_ms < 2000 THEN 'medium' ELSE 'long' END AS bin, count(*) AS n, sum(greatest(gap_ms - 800, 0))::BIGINT AS excess_ms FROM g GROUP BY 1")
def silence_histogram(spark, sf_dir):
    return sequence.gap_histogram(sequence.gaps(words(spark, sf_dir)))


SILENCE = """, u AS (SELECT rec_id, sent_idx, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY rec_id ORDER BY sent_idx), end_ms) AS until_ms FROM s),
d1 AS (SELECT g.rec_id, max(u.sent_idx) AS sent_idx, gap_start, gap_end, gap_start + 800 AS trim_start, 800::BIGINT AS keep_ms, gap_ms - 800 AS cut_ms FROM g JOIN u ON g.rec_id = u.rec_id AND gap_start BETWEEN u.start_ms - 500 AND u.until_ms + 500
  WHERE gap_ms > 800 AND gap_ms - 800 >= 100 GROUP BY g.rec_id, next_word, gap_start, gap_end, gap_ms)"""


@query(TL + SILENCE + " SELECT * FROM d1")
def silence_edits(spark, sf_dir):
    w = words(spark, sf_dir)
    return sequence.silence_edits(sequence.gaps(w), sequence.sentences(w))


@query(TL + " SELECT rec_id, sent_idx, start_ms, end_ms, coalesce(lead(start_ms) OVER (PARTITION BY rec_id ORDER BY sent_idx), end_ms) AS until_ms FROM s")
def sentence_until(spark, sf_dir):
    return sequence.sentence_starts(sequence.sentences(words(spark, sf_dir)))


SPK = """, p1 AS (SELECT *, sum(((lag_s <> speaker OR start_ms - lag_e >= 1000) AND lag_s IS NOT NULL)::INT) OVER (PARTITION BY rec_id ORDER BY word_idx) AS seg_id FROM (SELECT *, lag(speaker) OVER v AS lag_s, lag(end_ms) OVER v AS lag_e FROM w WINDOW v AS (PARTITION BY rec_id ORDER BY word_idx))),
p AS (SELECT rec_id, seg_id::BIGINT AS seg_id, arg_min(speaker, word_idx) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM p1 GROUP BY rec_id, seg_id)"""


@query(TL + SPK + " SELECT * FROM p")
def speaker_segments(spark, sf_dir):
    return sequence.speaker_segments(words(spark, sf_dir))


BLOCKS = ", b AS (SELECT rec_id, start_ms // 10000 AS seg_id, start_ms // 10000 * 10000 AS start_ms, start_ms // 10000 * 10000 + 10000 AS end_ms FROM w GROUP BY ALL)"


@query(
    TL + SPK + BLOCKS + """, o AS (SELECT b.rec_id, b.seg_id, speaker, sum(least(b.end_ms, p.end_ms) - greatest(b.start_ms, p.start_ms)) AS ms, min(p.start_ms) AS first FROM b JOIN p ON b.rec_id = p.rec_id AND greatest(b.start_ms, p.start_ms) < least(b.end_ms, p.end_ms) GROUP BY ALL)
SELECT rec_id, seg_id, speaker, ms::BIGINT AS overlap_ms FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id ORDER BY ms DESC, first) AS k FROM o) WHERE k = 1"""
)
def speaker_overlap_argmax(spark, sf_dir):
    w = words(spark, sf_dir)
    ten = w.select("rec_id", F.expr("start_ms div 10000").alias("seg_id")).distinct().select("rec_id", "seg_id", (F.col("seg_id") * 10000).alias("start_ms"), (F.col("seg_id") * 10000 + 10000).alias("end_ms"))
    return intervals.dominant_speaker(ten, sequence.speaker_segments(w))


@query(MERGED + " SELECT rec_id, start_ms, end_ms FROM m")
def interval_merge(spark, sf_dir):
    return intervals.merge(cuts(stored(spark, sf_dir)))


KEEP = """, dur AS (SELECT rec_id, max(end_ms) AS d FROM w GROUP BY rec_id),
k1 AS (SELECT rec_id, start_ms, end_ms FROM m UNION ALL SELECT rec_id, d, d FROM dur),
keep AS (SELECT * FROM (SELECT rec_id, coalesce(lag(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms), 0) AS start_ms, start_ms AS end_ms FROM k1) WHERE end_ms > start_ms)"""


@query(MERGED + KEEP + " SELECT * FROM keep")
def keep_complement(spark, sf_dir):
    w = stored(spark, sf_dir)
    return intervals.complement(intervals.merge(cuts(w)), intervals.durations(w))


@query(MERGED + " SELECT w.rec_id, word_idx, w.start_ms, (w.start_ms - coalesce((SELECT sum(least(m.end_ms, w.start_ms) - m.start_ms) FROM m WHERE m.rec_id = w.rec_id AND m.start_ms <= w.start_ms), 0))::BIGINT AS virtual_ms FROM w")
def virtual_time(spark, sf_dir):
    w = stored(spark, sf_dir)
    return intervals.virtual_time(w, intervals.merge(cuts(w)))


@query(
    CUTS + """, x AS (SELECT DISTINCT s.rec_id, s.sent_idx, s.start_ms, s.end_ms FROM s JOIN cut USING (rec_id, sent_idx)),
y AS (SELECT *, sum((sent_idx > pi + 1 AND pi IS NOT NULL)::INT) OVER (PARTITION BY rec_id ORDER BY sent_idx) AS seg_id FROM (SELECT *, lag(sent_idx) OVER (PARTITION BY rec_id ORDER BY sent_idx) AS pi FROM x))
SELECT rec_id, seg_id::BIGINT AS seg_id, CASE WHEN seg_id = 0 AND min(start_ms) < 5000 THEN 0 ELSE min(start_ms) END::BIGINT AS start_ms, max(end_ms) AS end_ms, count(*) AS n_sentences FROM y GROUP BY rec_id, seg_id"""
)
def segment_snap(spark, sf_dir):
    w = stored(spark, sf_dir)
    return intervals.snap_segments(sequence.sentences(w).select("rec_id", "sent_idx", "start_ms", "end_ms").join(cuts(w).select("rec_id", "sent_idx").distinct(), ["rec_id", "sent_idx"]))


KEPT = ", kw AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.rec_id = w.rec_id AND w.start_ms >= m.start_ms - 10 AND w.end_ms <= m.end_ms + 10))"


@query(MERGED + KEPT + " SELECT rec_id, word_idx, tok, start_ms, end_ms FROM kw")
def kept_words(spark, sf_dir):
    w = stored(spark, sf_dir)
    return intervals.kept_words(w, intervals.merge(cuts(w))).select("rec_id", "word_idx", "tok", "start_ms", "end_ms")


RESCAN = """, q1 AS (SELECT rec_id, word_idx AS next_word, lag(end_ms) OVER (PARTITION BY rec_id ORDER BY word_idx) + 800 AS start_ms, start_ms AS end_ms FROM kw),
q AS (SELECT * FROM q1 WHERE end_ms - start_ms > 0 AND end_ms - start_ms >= 50 AND NOT EXISTS (SELECT 1 FROM m WHERE m.rec_id = q1.rec_id AND abs(m.start_ms - q1.start_ms) <= 50))"""


@query(MERGED + KEPT + RESCAN + " SELECT * FROM q")
def postmerge_gaps(spark, sf_dir):
    w = stored(spark, sf_dir)
    m = durable(intervals.merge(cuts(w)))
    return intervals.rescan_gaps(intervals.kept_words(w, m), m)


NUM = ", e AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms, type, w_from) - 1 AS edit_id FROM cut)"


@query(MERGED + KEPT + RESCAN + NUM + " SELECT q.rec_id, next_word, count(*) AS n_edits, string_agg(edit_id::VARCHAR, ',' ORDER BY edit_id) AS depends_on FROM q JOIN e ON q.rec_id = e.rec_id AND greatest(q.start_ms, e.start_ms) < least(q.end_ms, e.end_ms) GROUP BY q.rec_id, next_word")
def gap_dependencies(spark, sf_dir):
    w = stored(spark, sf_dir)
    c = cuts(w)
    m = durable(intervals.merge(c))
    return intervals.gap_dependencies(intervals.rescan_gaps(intervals.kept_words(w, m), m), numbered(c))


@query(TL + " SELECT rec_id, next_word, gap_start + 300 AS start_ms, gap_end - 300 AS end_ms FROM g WHERE gap_end - gap_start - 600 > 10")
def silence_trims(spark, sf_dir):
    return intervals.silence_trims(sequence.gaps(words(spark, sf_dir)), 600)


@query(TL + RUNS + " SELECT rec_id, sent_idx, tok, w_from, w_to, run_len, start_ms, end_ms FROM r")
def stutter_runs(spark, sf_dir):
    return sequence.equal_runs(words(spark, sf_dir))


@query(TL + RUNS + D2 + f" SELECT {EDIT} FROM d2")
def stutter_edits(spark, sf_dir):
    return detect.stutter(words(spark, sf_dir))


@query(TL + " SELECT rec_id, word_idx, tok, start_ms, gap_ms FROM (SELECT *, start_ms - lag(end_ms) OVER v AS gap_ms, lag(tok) OVER v AS b FROM w WINDOW v AS (PARTITION BY rec_id ORDER BY word_idx)) WHERE b = tok AND gap_ms < 500")
def residual_stutter(spark, sf_dir):
    return detect.residual_stutter(words(spark, sf_dir))


@query(TL + f" SELECT rec_id, sent_idx, word_idx, tok, start_ms FROM pw WHERE n = 1 AND tok IN ({quoted([*P.fillers, *P.ambiguous, *P.mid_fillers])})")
def residual_filler(spark, sf_dir):
    return detect.residual_filler(words(spark, sf_dir))


D3 = ", d3 AS (SELECT rec_id, sent_idx, 'suffix_stutter' AS type, word_idx AS w_from, word_idx AS w_to, start_ms, end_ms, true AS needs_review, 0.8::DOUBLE AS confidence FROM pw WHERE length(tok) >= 2 AND length(before) > length(tok) AND ends_with(before, tok))"


@query(TL + D3 + " SELECT * FROM d3")
def suffix_stutter(spark, sf_dir):
    return detect.suffix_stutter(words(spark, sf_dir), skip_ascii=False)


@query(TL + D0 + " SELECT * FROM d0")
def leading_filler(spark, sf_dir):
    return detect.leading_filler(words(spark, sf_dir))


D4 = f""", d4 AS (SELECT rec_id, sent_idx, 'filler_mid' AS type, word_idx AS w_from, word_idx AS w_to, start_ms, end_ms, tok = '{P.mid_special}' AS needs_review, CASE WHEN tok = '{P.mid_special}' THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence
  FROM pw WHERE tok IN ({quoted(P.mid_fillers)}) AND i > 0 AND i < n - 1 AND end_ms - start_ms <= 500 AND (tok <> '{P.mid_special}' OR n > 3))"""


@query(TL + D4 + " SELECT * FROM d4")
def mid_filler(spark, sf_dir):
    return detect.mid_filler(words(spark, sf_dir))


@query(TL + D6 + " SELECT * FROM d6")
def consecutive_filler(spark, sf_dir):
    return detect.consecutive_filler(words(spark, sf_dir))


@query(
    TL + f""", x AS (SELECT *, min((tok IN ({quoted([*P.fillers, *P.ambiguous, *P.mid_fillers, *P.confirmations])}))::INT) OVER (PARTITION BY rec_id, sent_idx ORDER BY word_idx) AS ld FROM w)
SELECT rec_id, sent_idx, 'filler_run' AS type, min(word_idx) AS w_from, max(word_idx) AS w_to, min(start_ms) AS start_ms, max(end_ms) AS end_ms, false AS needs_review, 0.95::DOUBLE AS confidence FROM x WHERE ld = 1 GROUP BY rec_id, sent_idx HAVING count(*) >= 3"""
)
def filler_run(spark, sf_dir):
    return detect.filler_run(words(spark, sf_dir))


REP = ", n1 AS (SELECT *, lead(text) OVER v AS t1, lead(text, 2) OVER v AS t2, lead(sent_idx) OVER v AS i1 FROM s WINDOW v AS (PARTITION BY rec_id ORDER BY sent_idx)), rep AS (SELECT rec_id, sent_idx, i1 AS next_idx, CASE WHEN length(text) <= length(t1) THEN sent_idx ELSE i1 END AS delete_idx FROM n1 WHERE length(text) >= 5 AND left(text, 5) = left(t1, 5))"


@query(TL + REP + " SELECT * FROM rep")
def repeated_sentence_adjacent(spark, sf_dir):
    return detect.repeated_adjacent(sequence.sentences(words(spark, sf_dir)))


@query(TL + REP + " SELECT rec_id, sent_idx, sent_idx + 1 AS mid_idx, sent_idx + 2 AS again_idx FROM n1 WHERE length(text) >= 5 AND left(text, 5) = left(t2, 5) AND length(t1) <= 5")
def repeated_sentence_across(spark, sf_dir):
    return detect.repeated_across(sequence.sentences(words(spark, sf_dir)))


@query(
    TL + """, x AS (SELECT *, CASE WHEN lead(tok, 2) OVER v = tok THEN 2 WHEN lead(tok, 3) OVER v = tok THEN 3 WHEN lead(tok, 4) OVER v = tok THEN 4 END AS d FROM pw WINDOW v AS (PARTITION BY rec_id, sent_idx ORDER BY word_idx))
SELECT rec_id, sent_idx, tok, word_idx AS w_from, word_idx + d - 1 AS w_to, d::BIGINT AS distance FROM x WHERE d IS NOT NULL AND after <> tok"""
)
def word_repeat_gap(spark, sf_dir):
    return detect.word_repeat_gap(words(spark, sf_dir))


CONJ = " OR ".join(f"starts_with(phrase, '{c}')" for c in P.conjunctions)
D5 = f""", c AS (SELECT *, sum(length(tok)) OVER (PARTITION BY rec_id, sent_idx ORDER BY word_idx) AS c1 FROM pw),
x1 AS (SELECT rec_id, sent_idx, any_value(n) AS n, string_agg(tok, '' ORDER BY word_idx) AS text FROM pw GROUP BY rec_id, sent_idx),
x2 AS (SELECT *, unnest(range(3, least(length(text) // 2, 20) + 1)) AS ln FROM x1 WHERE length(text) >= 8),
x3 AS (SELECT *, unnest(range(0, length(text) - 2 * ln + 1)) AS p0 FROM x2),
x4 AS (SELECT *, substr(text, p0 + 1, ln) AS phrase FROM x3),
x5 AS (SELECT *, instr(substr(text, p0 + ln + 1, 3 * ln), phrase) - 1 AS gap FROM x4),
x6 AS (SELECT *, row_number() OVER (PARTITION BY rec_id, sent_idx ORDER BY ln DESC, p0) AS k FROM x5 WHERE gap >= 0 AND NOT (ln <= 3 AND gap = 0) AND phrase <> repeat(left(phrase, 1), ln) AND NOT ({CONJ})),
x7 AS (SELECT x6.rec_id, x6.sent_idx, x6.n, ln, gap, min(word_idx) AS w_from, max(word_idx) AS w_to, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(length(tok)) AS cutlen FROM x6 JOIN c ON c.rec_id = x6.rec_id AND c.sent_idx = x6.sent_idx AND c1 > p0 AND c1 - length(tok) <= p0 + ln + gap - 1 WHERE k = 1 GROUP BY ALL),
d5 AS (SELECT rec_id, sent_idx, 'in_sentence_repeat' AS type, w_from, w_to, start_ms, end_ms, NOT (ln >= 5 AND gap <= 3) AS needs_review, CASE WHEN ln >= 5 AND gap <= 3 THEN 0.9 WHEN ln <= 4 THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM x7 WHERE w_to - w_from + 1 < n AND cutlen <= ln + gap + 4)"""


@query(TL + D5 + " SELECT * FROM d5")
def phrase_repeat(spark, sf_dir):
    return detect.phrase_repeat(words(spark, sf_dir))


D7 = f""", z0 AS (SELECT rec_id, sent_idx, list(tok ORDER BY word_idx) AS toks, list(word_idx ORDER BY word_idx) AS ix, list(start_ms ORDER BY word_idx) AS st, list(end_ms ORDER BY word_idx) AS en, count(*) AS n FROM w GROUP BY rec_id, sent_idx HAVING count(*) >= 4),
z1 AS (SELECT *, unnest(range(1, n - 1)) AS m FROM z0),
z2 AS (SELECT *, CASE WHEN toks[m + 1] || coalesce(toks[m + 2], '') IN ({quoted(P.markers2)}) AND m + 1 < n - 1 THEN 2 WHEN toks[m + 1] IN ({quoted(P.markers)}) THEN 1 END AS k FROM z1),
z3 AS (SELECT *, least(m, n - m - k, 5) AS c FROM z2 WHERE k IS NOT NULL AND m + k < n),
z4 AS (SELECT *, array_to_string(toks[m - c + 1:m], '') AS b, array_to_string(toks[m + k + 1:m + k + c], '') AS a FROM z3),
z5 AS (SELECT *, row_number() OVER (PARTITION BY rec_id, sent_idx ORDER BY m) AS j FROM z4 WHERE len(list_filter(string_split(b, ''), lambda x: contains(a, x)))::DOUBLE / length(b) >= 0.6),
d7 AS (SELECT rec_id, sent_idx, 'self_correction' AS type, ix[1] AS w_from, ix[m + k] AS w_to, st[1] AS start_ms, en[m + k] AS end_ms, true AS needs_review, 0.7::DOUBLE AS confidence FROM z5 WHERE j = 1)"""


@query(TL + D7 + " SELECT * FROM d7")
def restart_marker(spark, sf_dir):
    return detect.restart_marker(words(spark, sf_dir))


@query(
    TL + """, a AS (SELECT rec_id, sent_idx, list(tok ORDER BY word_idx) AS toks, list(word_idx ORDER BY word_idx) AS ix, list(start_ms ORDER BY word_idx) AS st, list(end_ms ORDER BY word_idx) AS en, count(*) AS n FROM w GROUP BY rec_id, sent_idx HAVING count(*) >= 4),
b AS (SELECT *, unnest(range(0, n - 3)) AS i FROM a), c AS (SELECT *, unnest([2, 3, 4, 5]) AS k FROM b), d AS (SELECT *, unnest(range(i + k, greatest(i + k, least(i + 8, n - k - 1)) + 1)) AS j FROM c WHERE i + 2 * k < n),
e AS (SELECT *, array_to_string(toks[i + 1:i + k], '') AS px, toks[i + k + 1:j] AS mid FROM d WHERE j + k < n AND toks[i + 1:i + k] = toks[j + 1:j + k] AND NOT (j > i + k + 1 AND j + k + 1 < n AND toks[i + k + 1] = toks[j + k + 1] AND toks[i + k + 2] = toks[j + k + 2])),
e1 AS (SELECT *, list_filter(mid, lambda x: x NOT IN ({H}))[1] AS g1, list_filter(toks[j + k + 1:], lambda x: x NOT IN ({H}))[1] AS g2, len(list_filter(mid, lambda x: x IN ({H}))) > 0 AS hs, len(list_filter(range(0, n - k + 1), lambda q: toks[q + 1:q + k] = toks[i + 1:i + k])) AS times FROM e WHERE length(px) >= 3),
f AS (SELECT *, coalesce(g1 <> g2, false) AND (NOT hs OR j - i - k > 1 OR times >= 3) AS par, row_number() OVER (PARTITION BY rec_id, sent_idx, i ORDER BY k DESC, j) AS q FROM e1),
l AS (SELECT rec_id, sent_idx, list([{'i': i, 'j': j, 'wf': ix[i + 1], 'wt': ix[j], 's0': st[i + 1], 's1': en[j], 'z': length(px)}] ORDER BY i) AS c FROM f WHERE q = 1 AND NOT par GROUP BY rec_id, sent_idx),
o AS (SELECT rec_id, sent_idx, unnest(list_reduce(c, lambda acc, x: CASE WHEN x[1].i >= acc[-1].j THEN list_concat(acc, x) ELSE acc END)) AS e FROM l)
SELECT rec_id, sent_idx, 'same_prefix' AS type, e.wf AS w_from, e.wt AS w_to, e.s0 AS start_ms, e.s1 AS end_ms, true AS needs_review, CASE WHEN e.z >= 4 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM o""".replace("{H}", quoted(P.hesitations))
)
def prefix_expansion(spark, sf_dir):
    return detect.prefix_expansion(words(spark, sf_dir))


NB = """, nb AS (SELECT rec_id, sent_idx, word_idx, lag(end_ms) OVER a AS prev_end, lead(start_ms) OVER a AS next_start, lag(end_ms) OVER b AS sent_prev_end, lead(start_ms) OVER b AS sent_next_start FROM w
  WINDOW a AS (PARTITION BY rec_id ORDER BY word_idx), b AS (PARTITION BY rec_id, sent_idx ORDER BY word_idx))"""


@query(TL + NB + " SELECT * FROM nb")
def prev_next_word(spark, sf_dir):
    return resolve.neighbours(words(spark, sf_dir))


def w10(src: str) -> str:
    return f"""SELECT e.rec_id, e.sent_idx, type, w_from, w_to, CASE WHEN start_ms - x.sent_prev_end BETWEEN 0 AND 199 THEN x.sent_prev_end ELSE start_ms END AS start_ms, CASE WHEN y.sent_next_start - end_ms BETWEEN 0 AND 199 THEN y.sent_next_start ELSE end_ms END AS end_ms, needs_review, confidence
FROM {src} e LEFT JOIN nb x ON x.rec_id = e.rec_id AND x.word_idx = w_from LEFT JOIN nb y ON y.rec_id = e.rec_id AND y.word_idx = w_to"""


@query(CUTS + NB + " " + w10("cut"))
def boundary_extension(spark, sf_dir):
    w = stored(spark, sf_dir)
    return resolve.extend_boundaries(cuts(w), w)


@query(
    CUTS + NB + """ SELECT e.rec_id, w_from, w_to, CASE WHEN start_ms - x.prev_end > 50 THEN x.prev_end + 50 ELSE start_ms END AS start_ms, end_ms, coalesce(start_ms - x.prev_end < 50, false) AS refine_start, coalesce(y.next_start - end_ms < 50, false) AS refine_end
FROM cut e LEFT JOIN nb x ON x.rec_id = e.rec_id AND x.word_idx = w_from LEFT JOIN nb y ON y.rec_id = e.rec_id AND y.word_idx = w_to"""
)
def pre_onset_extension(spark, sf_dir):
    w = stored(spark, sf_dir)
    return resolve.extend_onset(cuts(w), w)


@query(
    CUTS + NUM + """, l AS (SELECT rec_id, sent_idx, list([{'a': start_ms, 'b': end_ms, 'id': edit_id}] ORDER BY start_ms, end_ms, edit_id) AS es FROM e GROUP BY rec_id, sent_idx),
f AS (SELECT rec_id, sent_idx, list_reduce(es, lambda acc, x: CASE
    WHEN len(list_filter(acc, lambda y: greatest(y.a, x[1].a) < least(y.b, x[1].b))) = 0 THEN list_concat(acc, x)
    WHEN x[1].b - x[1].a > list_filter(acc, lambda y: greatest(y.a, x[1].a) < least(y.b, x[1].b))[1].b - list_filter(acc, lambda y: greatest(y.a, x[1].a) < least(y.b, x[1].b))[1].a
      THEN list_transform(acc, lambda z: CASE WHEN z.id = list_filter(acc, lambda y: greatest(y.a, x[1].a) < least(y.b, x[1].b))[1].id THEN x[1] ELSE z END)
    ELSE acc END) AS ks FROM l),
k AS (SELECT rec_id, sent_idx, unnest(ks) AS k FROM f) SELECT rec_id, sent_idx, k.id AS edit_id, k.a AS start_ms, k.b AS end_ms FROM k"""
)
def edit_resolve_greedy(spark, sf_dir):
    return resolve.greedy_larger(numbered(cuts(stored(spark, sf_dir))))


@query(
    TL.replace("WITH ", "WITH RECURSIVE ", 1) + """, pt AS (SELECT rec_id, gap_start AS p FROM g), q AS (SELECT rec_id, min(p) AS p FROM pt GROUP BY rec_id
  UNION ALL SELECT q.rec_id, min(pt.p) AS p FROM q JOIN pt ON pt.rec_id = q.rec_id AND pt.p > q.p + 5000 GROUP BY q.rec_id)
SELECT rec_id, p AS at_ms FROM q"""
)
def spacing_thin(spark, sf_dir):
    return sequence.greedy_spacing(sequence.gaps(words(spark, sf_dir)).select("rec_id", F.col("gap_start").alias("at_ms")), 5000, "at_ms")


SPAN = TL + """, sp AS (SELECT DISTINCT rec_id, sent_idx + (i % 2) AS sent_idx, tok || after AS span FROM pw WHERE after IS NOT NULL),
ch AS (SELECT *, sum(length(tok)) OVER (PARTITION BY rec_id, sent_idx ORDER BY word_idx) AS c1 FROM w),
tx AS (SELECT rec_id, sent_idx, string_agg(tok, '' ORDER BY word_idx) AS text FROM w GROUP BY rec_id, sent_idx),
hit AS (SELECT sp.rec_id, sp.sent_idx, span, tx.sent_idx AS in_sent, instr(text, span) - 1 AS p0 FROM sp JOIN tx ON tx.rec_id = sp.rec_id AND tx.sent_idx IN (sp.sent_idx, sp.sent_idx - 1) WHERE contains(text, span)),
best AS (SELECT *, p0 + length(span) AS p1 FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, sent_idx, span ORDER BY in_sent DESC) AS k FROM hit) WHERE k = 1),
j AS (SELECT best.*, word_idx, start_ms, end_ms, c1 - length(tok) AS c0, c1 FROM best JOIN ch ON ch.rec_id = best.rec_id AND ch.sent_idx = in_sent AND c1 > p0 AND c1 - length(tok) < p1)
SELECT rec_id, sent_idx, span, in_sent, min(word_idx) AS w_from, max(word_idx) AS w_to, min(CASE WHEN c0 <= p0 THEN start_ms + (end_ms - start_ms) * (p0 - c0) // (c1 - c0) END)::BIGINT AS start_ms,
  max(CASE WHEN c1 >= p1 THEN start_ms + (end_ms - start_ms) * (p1 - c0) // (c1 - c0) END)::BIGINT AS end_ms, bool_or(c0 < p0 OR c1 > p1) AS partial FROM j GROUP BY rec_id, sent_idx, span, in_sent"""


@query(SPAN)
def text_span_map(spark, sf_dir):
    # two neighbouring words as the text that a judge would quote, by turns under the sentence itself and the one after
    w = words(spark, sf_dir)
    t = detect.placed(w).withColumn("after", F.lead("tok").over(sequence.order("word_idx", keys=detect.SENT))).filter("after is not null")
    spans = t.select("rec_id", (F.col("sent_idx") + F.col("i") % 2).alias("sent_idx"), F.concat("tok", "after").alias("span")).distinct()
    return resolve.map_spans(spans, w)


ACCEPT = (
    TL + RUNS + D2 + D0 + D3 + D4 + D5 + D6 + D7 + SILENCE + NB + f""", a0 AS (SELECT {EDIT} FROM d0 UNION ALL SELECT rec_id, sent_idx, 'silence', NULL, NULL, gap_start, gap_end, false, 1.0::DOUBLE FROM d1 UNION ALL SELECT {EDIT} FROM d2),
a3 AS (SELECT * FROM a0 UNION ALL SELECT * FROM d3 x WHERE NOT EXISTS (SELECT 1 FROM a0 y WHERE y.type <> 'silence' AND y.rec_id = x.rec_id AND y.sent_idx = x.sent_idx AND x.start_ms < y.end_ms AND x.end_ms > y.start_ms)),
a4 AS (SELECT * FROM a3 UNION ALL SELECT * FROM d4 x WHERE NOT EXISTS (SELECT 1 FROM a3 y WHERE y.rec_id = x.rec_id AND y.sent_idx = x.sent_idx AND abs(x.start_ms - y.start_ms) < 100)),
a5 AS (SELECT * FROM a4 UNION ALL SELECT * FROM d5 x WHERE NOT EXISTS (SELECT 1 FROM a4 y WHERE y.type <> 'silence' AND y.rec_id = x.rec_id AND y.sent_idx = x.sent_idx AND x.start_ms < y.end_ms AND x.end_ms > y.start_ms)),
a6 AS (SELECT * FROM a5 UNION ALL SELECT * FROM d6 x WHERE NOT EXISTS (SELECT 1 FROM a5 y WHERE y.type <> 'silence' AND y.rec_id = x.rec_id AND y.sent_idx = x.sent_idx AND x.start_ms < y.end_ms AND x.end_ms > y.start_ms)),
a7 AS (SELECT * FROM a6 UNION ALL SELECT * FROM d7 x WHERE NOT EXISTS (SELECT 1 FROM a6 y WHERE y.rec_id = x.rec_id AND y.sent_idx = x.sent_idx AND abs(x.start_ms - y.start_ms) < 100)),
rules AS (""" + w10("a7") + ")"
)


@query(ACCEPT + " SELECT * FROM rules")
def rule_edits(spark, sf_dir):
    return cut_analysis.rule_edits(stored(spark, sf_dir))


@query(ACCEPT + " SELECT type, count(*) AS n_edits, count(*) FILTER (needs_review) AS n_review, sum(end_ms - start_ms - CASE WHEN type = 'silence' THEN 800 ELSE 0 END)::BIGINT AS saved_ms FROM rules GROUP BY type")
def edit_summary(spark, sf_dir):
    e = cut_analysis.rule_edits(stored(spark, sf_dir))
    return resolve.summary(e.withColumn("keep_ms", F.when(F.col("type") == "silence", P.silence).otherwise(0)))


@query(CUTS + ", k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rec_id, w_from, start_ms) AS k FROM cut) SELECT type, count(*) AS n_edits, sum(end_ms - start_ms)::BIGINT AS total_ms, string_agg(rec_id::VARCHAR || ':' || w_from::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS examples FROM k GROUP BY type")
def deletion_types(spark, sf_dir):
    return evaluate.by_type(cuts(stored(spark, sf_dir)))


@query(MERGED + ", d AS (SELECT rec_id, max(end_ms) AS dur FROM w GROUP BY rec_id), c AS (SELECT rec_id, sum(end_ms - start_ms) AS cut_ms FROM m GROUP BY rec_id), f AS (SELECT rec_id, coalesce(cut_ms, 0)::BIGINT AS cut_ms, (coalesce(cut_ms, 0) * 10000 // dur)::BIGINT AS share_bp FROM d LEFT JOIN c USING (rec_id)) SELECT *, CASE WHEN share_bp < 1500 THEN 'light' WHEN share_bp < 3000 THEN 'medium' ELSE 'heavy' END AS style FROM f")
def aggressiveness(spark, sf_dir):
    w = stored(spark, sf_dir)
    return evaluate.aggressiveness(intervals.merge(cuts(w)), intervals.durations(w))


@query(
    MERGED + """, b AS (SELECT m.rec_id, seg_id, tok, word_idx, row_number() OVER (PARTITION BY m.rec_id, seg_id ORDER BY word_idx DESC) AS k FROM m JOIN w ON w.rec_id = m.rec_id AND w.end_ms <= m.start_ms AND w.end_ms > m.start_ms - 5000),
a AS (SELECT m.rec_id, seg_id, tok, word_idx, row_number() OVER (PARTITION BY m.rec_id, seg_id ORDER BY word_idx) AS k FROM m JOIN w ON w.rec_id = m.rec_id AND w.start_ms >= m.end_ms AND w.start_ms < m.end_ms + 5000)
SELECT rec_id, seg_id, coalesce((SELECT string_agg(tok, ' ' ORDER BY word_idx) FROM b WHERE b.rec_id = m.rec_id AND b.seg_id = m.seg_id AND k <= 8), '') AS before_text, coalesce((SELECT string_agg(tok, ' ' ORDER BY word_idx) FROM a WHERE a.rec_id = m.rec_id AND a.seg_id = m.seg_id AND k <= 8), '') AS after_text FROM m"""
)
def context_words(spark, sf_dir):
    w = stored(spark, sf_dir)
    return audit.context(segments(w), w)


@query(
    TL + """, j AS (SELECT g.rec_id, next_word AS p_id, word_idx, tok, abs(w.start_ms - gap_start) AS away_ms FROM g JOIN w ON w.rec_id = g.rec_id AND w.start_ms < gap_start + 3000 AND w.end_ms > greatest(gap_start - 3000, 0))
SELECT rec_id, p_id, arg_min(word_idx, (away_ms, word_idx)) AS word_idx, arg_min(tok, (away_ms, word_idx)) AS tok, min(away_ms) AS away_ms, count(*) AS n_context FROM j GROUP BY rec_id, p_id"""
)
def nearest_word_context(spark, sf_dir):
    w = words(spark, sf_dir)
    return audit.nearest_word(sequence.gaps(w).select("rec_id", F.col("next_word").alias("p_id"), F.col("gap_start").alias("at")), w)
