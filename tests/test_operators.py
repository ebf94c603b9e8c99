"""Documented cases, invariants and plain-Python mirrors of the operators."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from utterframe import catalogue
from utterframe.functions import formats
from utterframe.operators import align, audit, detect, evaluate, intervals, resolve, sequence
from utterframe.params import PARAMS

SF = "/root/testdata/sf0.001"


def words_of(spark, tokens, sents=None, step=200, dur=150):
    """One recording of given tokens; ``sents`` gives each token's sentence."""
    rows = [(1, i, 0, t, t, "a", i * step, i * step + dur, (sents or [0] * len(tokens))[i]) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "rec_id long, word_idx long, turn long, raw string, tok string, speaker string, start_ms long, end_ms long, sent_idx long")


def spans(df):
    return sorted((r["w_from"], r["w_to"]) for r in df.collect())


def test_stutter_cases(spark):
    assert spans(detect.stutter(words_of(spark, ["第一", "第一", "份", "工作"]))) == [(0, 0)]
    assert spans(detect.stutter(words_of(spark, ["都"] * 5 + ["被"]))) == [(i, i) for i in range(4)]
    p = replace(PARAMS, reduplicated=("媽媽", "看看", "哈哈"))
    assert spans(detect.stutter(words_of(spark, ["媽", "媽", "看", "看"]), p)) == []
    assert spans(detect.stutter(words_of(spark, ["2", "2", "0"]))) == []
    assert spans(detect.stutter(words_of(spark, ["粉", "嘟", "嘟"]))) == []


def test_word_repeat_and_phrase_cases(spark):
    assert spans(detect.word_repeat_gap(words_of(spark, ["所以", "小", "所以"]))) == [(0, 1)]
    t = ["我", "覺得", "這個", "事情", "嗯", "我", "覺得", "這個", "事情", "很", "重要"]
    assert spans(detect.phrase_repeat(words_of(spark, t))) == [(0, 4)]
    p = replace(PARAMS, conjunctions=("然後",))
    assert spans(detect.phrase_repeat(words_of(spark, ["然後", "c", "也會用", "然後", "d", "吧吧"]), p)) == []


def test_filler_run_and_restart_cases(spark):
    p = replace(PARAMS, fillers=("嗯嗯", "呃", "對"), ambiguous=(), mid_fillers=(), markers=("等一下",), markers2=())
    assert spans(detect.filler_run(words_of(spark, ["嗯嗯", "呃", "對", "就是", "我"]), p)) == [(0, 2)]
    t = ["hello", "大家好", "等一下", "hello", "大家好"]
    assert spans(detect.restart_marker(words_of(spark, t), p)) == [(0, 2)]
    assert spans(detect.prefix_expansion(words_of(spark, ["是一個", "底層", "是一個", "底層", "boss"]))) == [(0, 1)]


def test_repeated_sentences(spark):
    df = spark.createDataFrame([(1, 0, "好我們接下來開始怎麼去"), (1, 1, "好我們接下來開始怎麼去做一個剪口拨"), (2, 0, "我覺得這樣"), (2, 1, "他呢"), (2, 2, "我覺得這樣好")], "rec_id long, sent_idx long, text string")
    assert [(r["rec_id"], r["delete_idx"]) for r in detect.repeated_adjacent(df).collect()] == [(1, 0)]
    assert [(r["rec_id"], r["sent_idx"]) for r in detect.repeated_across(df).collect()] == [(2, 0)]


def test_interval_merge_case(spark):
    iv = [(0, 10), (5, 20), (21, 30), (30, 40), (100, 110), (101, 102), (105, 130)]
    df = spark.createDataFrame([(1, a, b) for a, b in iv], "rec_id long, start_ms long, end_ms long")
    assert sorted((r["start_ms"], r["end_ms"]) for r in intervals.merge(df, 0).collect()) == [(0, 20), (21, 40), (100, 130)]


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_sets(spark, seed):
    r = random.Random(seed)
    iv = [(k, a, a + r.randrange(1, 9)) for k in (1, 2, 3) for a in (r.randrange(100) for _ in range(12))]
    df = spark.createDataFrame(iv, "rec_id long, start_ms long, end_ms long")
    merged = intervals.merge(df, 0)
    keep = intervals.complement(merged, spark.createDataFrame([(k, 150) for k in (1, 2, 3, 4)], "rec_id long, duration_ms long"))
    m, c = merged.collect(), keep.collect()
    for k in (1, 2, 3, 4):
        covered = {x for j, a, b in iv if j == k for x in range(a, b)}
        in_m = [x for s in m if s["rec_id"] == k for x in range(s["start_ms"], s["end_ms"])]
        in_c = [x for s in c if s["rec_id"] == k for x in range(s["start_ms"], s["end_ms"])]
        assert len(in_m) == len(set(in_m)) and set(in_m) == covered
        assert sorted(in_m + in_c) == list(range(150))
    other = [(k, n, a, a + r.randrange(1, 400)) for k in (1, 2) for n, a in enumerate(r.randrange(1000) for _ in range(20))]
    l = spark.createDataFrame(other, "rec_id long, l_id long, l_start long, l_end long")
    right = spark.createDataFrame([(k, n, a, b) for n, (k, a, b) in enumerate(iv)], "rec_id long, r_id long, r_start long, r_end long")
    got = sorted((x["rec_id"], x["l_id"], x["r_id"]) for x in intervals.overlapping(l, right, 30).collect())
    assert got == sorted((k, n, m) for k, n, a, b in other for m, (j, c0, d0) in enumerate(iv) if j == k and max(a, c0) < min(b, d0))


def test_greedy_cases(spark):
    pts = spark.createDataFrame([(1, x) for x in (1, 2, 4, 9, 10, 16)], "rec_id long, at long")
    assert sorted(r["at"] for r in sequence.greedy_spacing(pts, 5).collect()) == [1, 9, 16]
    e = spark.createDataFrame([(1, 0, n, a, b) for n, (a, b) in enumerate([(0, 5), (3, 20), (18, 22), (30, 31)])], "rec_id long, sent_idx long, edit_id long, start_ms long, end_ms long")
    assert sorted((r["start_ms"], r["end_ms"]) for r in resolve.greedy_larger(e).collect()) == [(3, 20), (30, 31)]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_mirrors(spark, seed):
    r = random.Random(seed)
    es = [(k, n, a, a + r.randrange(1, 30)) for k in range(5) for n, a in enumerate(r.randrange(100) for _ in range(12))]
    df = spark.createDataFrame([(1, *x) for x in es], "rec_id long, sent_idx long, edit_id long, start_ms long, end_ms long")
    want = []
    for k in range(5):
        acc = []
        for a, b, n in sorted((a, b, n) for j, n, a, b in es if j == k):
            hit = next((i for i, (x, y, _) in enumerate(acc) if max(x, a) < min(y, b)), None)
            if hit is None:
                acc.append((a, b, n))
            elif b - a > acc[hit][1] - acc[hit][0]:
                acc[hit] = (a, b, n)
        want += [(k, n) for _, _, n in acc]
    assert sorted((x["sent_idx"], x["edit_id"]) for x in resolve.greedy_larger(df).collect()) == sorted(want)


def test_partial_word_span(spark):
    w = spark.createDataFrame([(1, 0, 0, "就是要就是", "就是要就是", "a", 690690, 692530, 0)], "rec_id long, word_idx long, turn long, raw string, tok string, speaker string, start_ms long, end_ms long, sent_idx long")
    s = spark.createDataFrame([(1, 0, "就是要"), (1, 0, "沒有")], "rec_id long, sent_idx long, span string")
    r = resolve.map_spans(s, w).collect()
    assert len(r) == 1 and (r[0]["start_ms"], r[0]["end_ms"], r[0]["partial"]) == (690690, 691794, True)


def test_merged_gap_case(spark):
    w = words_of(spark, ["a", "b", "c"])
    rows = [(1, 0, 0, "a", "a", "x", 0, 1000, 0), (1, 1, 0, "b", "b", "x", 1900, 2400, 0)]
    kept = spark.createDataFrame(rows, w.schema)
    none = spark.createDataFrame([], "rec_id long, start_ms long, end_ms long")
    assert [(r["start_ms"], r["end_ms"]) for r in intervals.rescan_gaps(kept, none).collect()] == [(1800, 1900)]


def test_precision_and_recall_case(spark):
    rows = [("x", True, True)] * 24 + [("x", False, True)] * 5 + [("x", True, False)] * 8
    df = spark.createDataFrame(rows, "k string, g boolean, p boolean")
    r = evaluate.prf(df, "k", F.col("g"), F.col("p")).filter("k = 'all'").first()
    assert (r["tp"], r["fp"], r["fn"], r["precision_bp"], r["recall_bp"]) == (24, 5, 8, 8275, 7500)


def test_rule_edits_lie_in_their_sentence_and_do_not_depend_on_partitions(spark):
    from utterframe.plans.cut_analysis import rule_edits

    w = sequence.timeline(spark.read.parquet(f"{SF}/conversations.parquet"))
    e = rule_edits(w)
    s = sequence.sentences(w).select("rec_id", "sent_idx", "w_start", "w_end")
    assert e.join(s, ["rec_id", "sent_idx"]).filter("w_from < w_start or w_to > w_end").count() == 0
    other = rule_edits(sequence.timeline(spark.read.parquet(f"{SF}/conversations.parquet").repartition(7)))
    assert sorted(map(str, e.collect())) == sorted(map(str, other.collect()))


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_table():
    r = random.Random(0)
    for _ in range(400):
        a, b = ([r.choice("abc") for _ in range(r.randrange(12))] for _ in range(2))
        missing = align.lcs_missing(a, b)
        kept = [x for i, x in enumerate(a) if i not in missing]
        it = iter(b)
        assert all(x in it for x in kept) and len(kept) == brute_lcs(a, b)


def test_missing_and_alignment(spark):
    w = words_of(spark, list("abcdefgh"))
    cut = w.filter("word_idx not in (2, 3, 4)")
    runs = align.missing_runs(align.missing_words(w, cut)).collect()
    assert [(r["w_from"], r["w_to"], r["n_words"]) for r in runs] == [(2, 4, 3)]
    b = spark.createDataFrame([(1, 0, "one two three"), (1, 1, "gone"), (1, 2, "four five six seven")], "rec_id long, sent_idx long, text string")
    a = spark.createDataFrame([(1, 0, "one two three"), (1, 1, "four five six sevn")], "rec_id long, sent_idx long, text string")
    assert {r["sent_idx"]: r["state"] for r in align.align_sentences(b, a).collect()} == {0: "kept", 1: "deleted", 2: "changed"}


def test_reviews_and_ladder(spark):
    e = spark.createDataFrame([(1, 0, "a", 0, 0, 0, 1, True, 0.8), (1, 0, "b", 1, 1, 1, 2, True, 0.8), (1, 1, "a", 2, 2, 2, 3, True, 0.8), (1, 1, "c", 3, 3, 3, 4, False, 0.9), (1, 2, "a", 4, 4, 4, 5, True, 0.8)], "rec_id long, sent_idx long, type string, w_from long, w_to long, start_ms long, end_ms long, needs_review boolean, confidence double")
    r = spark.createDataFrame([(1, 0, "confirm"), (1, 1, "reject")], "rec_id long, sent_idx long, action string")
    got = sorted((x["w_from"], x["confidence"]) for x in resolve.apply_reviews(e, r).collect())
    assert got == [(0, 0.9), (1, 0.75), (3, 0.9), (4, 0.75)]
    f = spark.createDataFrame([("k", i, m) for i, m in enumerate([1, 1, 1, -1, -1, -1, -1, 1])], "key string, at long, m int")
    assert evaluate.ladder(f, F.col("m") > 0, F.col("m") < 0).first()["level"] == 1
    r = random.Random(0)
    ms = {k: [r.choice([1, -1]) for _ in range(r.randrange(1, 40))] for k in range(30)}
    f = spark.createDataFrame([(k, i, m) for k, xs in ms.items() for i, m in enumerate(xs)], "key long, at long, m int")
    want = {}
    for k, xs in ms.items():
        want[k] = 1
        for m in xs:
            want[k] = min(max(want[k] + m, 0), 2)
    for chunk in (3, 10_000):
        assert {x["key"]: x["level"] for x in evaluate.ladder(f, F.col("m") > 0, F.col("m") < 0, chunk=chunk).collect()} == want


def test_audit_fix(spark):
    seg = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 3000, 4000)], "rec_id long, seg_id long, start_ms long, end_ms long")
    gap = spark.createDataFrame([(1, 1020, 1500), (1, 2500, 2960), (1, 6000, 6500)], "rec_id long, start_ms long, end_ms long")
    assert sorted((r["start_ms"], r["end_ms"]) for r in audit.fix_gaps(seg, gap).collect()) == [(0, 1500), (2500, 4000), (6000, 6500)]


def test_formats(spark):
    r = spark.range(1).select(
        formats.clock(F.lit(3725000)).alias("h"), formats.clock(F.lit(65000)).alias("m"), formats.slug(F.lit("_a b/c_")).alias("s"), formats.strip_class(F.lit("嗯，好。")).alias("p"), formats.strip_ends(F.lit("，好，的。")).alias("e"),
        formats.has_repeat(F.lit("abab")).alias("r"), formats.has_repeat(F.lit("abc")).alias("n"), formats.ramp(F.lit(9)).alias("c"), formats.shifted(F.lit(5), F.lit(-9)).alias("z"), formats.fade_ms(F.lit(1000)).alias("f"), formats.normalise(F.lit("a, b!")).alias("o"),
    ).first()
    assert tuple(r) == ("1:02:05", "1:05", "a_b_c", "嗯好", "好，的", True, False, 9500, 0, 80, "ab")


def test_scores(spark):
    r = spark.range(1).select(evaluate.merged_score(F.lit(100), F.lit(73)).alias("m"), evaluate.merged_score(F.lit(90), F.lit(None).cast("int")).alias("s"), evaluate.score_class(F.lit(83)).alias("g"), evaluate.score_class(F.lit(None).cast("int")).alias("x")).first()
    assert tuple(r) == (838, 900, "good", "")


def test_plans_push_down(spark):
    from utterframe import catalogue

    plan = catalogue.queries()["page_metadata"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "page_id" in plan and "lang" not in plan


def test_common_parts_in_bounded_memory():
    """The way back through kept rows gives what the whole table gives."""
    r = random.Random(3)
    for _ in range(60):
        x, y = ([r.choice("abcd") for _ in range(r.randrange(0, 40))] for _ in range(2))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            for j, q in enumerate(y, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if p == q else max(t[i - 1][j], t[i][j - 1])
        missing = align.lcs_missing(x, y)
        assert len(x) - len(missing) == t[-1][-1]
        kept, at = [w for i, w in enumerate(x) if i not in set(missing)], 0
        for w in kept:
            at = y.index(w, at) + 1


def test_spacing_keeps_points_far_apart(spark):
    r = random.Random(4)
    rows = [(k, r.randrange(3000)) for k in range(5) for _ in range(200)]
    got = sorted(tuple(x) for x in sequence.greedy_spacing(spark.createDataFrame(rows, "rec_id long, at long"), 100).collect())
    want = []
    for k in range(5):
        last = None
        for a in sorted(a for i, a in rows if i == k):
            if last is None or a - last > 100:
                want.append((k, a))
                last = a
    assert got == want


def test_strongest_far_apart(spark):
    from utterframe.operators import review

    r = random.Random(5)
    rows = [(k, r.randrange(20_000), r.randrange(50)) for k in range(4) for _ in range(300)]
    rows = list({(k, a): (k, a, m) for k, a, m in rows}.values())
    got = sorted((x["key"], x["at_ms"], x["metric"]) for x in review.top_spaced(spark.createDataFrame(rows, "key long, at long, metric long"), 6, 700).collect())
    want = []
    for k in range(4):
        taken = []
        for _, a, m in sorted(((k, a, m) for i, a, m in rows if i == k), key=lambda x: (-x[2], x[1])):
            if len(taken) < 6 and all(abs(a - b) >= 700 for b, _ in taken):
                taken.append((a, m))
        want += [(k, a, m) for a, m in taken]
    assert got == sorted(want)


def test_rules_from_yaml(spark, tmp_path):
    from utterframe.sources import readers

    (tmp_path / "silence.yaml").write_text("# limits\nthreshold: 3.0  # seconds\nname: 'long pause'\nnested:\n  mode: review\n  deep:\n    x: 1\nlist:\n  - a\n")
    (tmp_path / "fillers.yml").write_text("action: \"delete\"\n")
    (tmp_path / "notes.txt").write_text("not: read\n")
    got = sorted(tuple(r) for r in readers.read_rules(spark, str(tmp_path)).collect())
    assert got == [("fillers", "action", "delete"), ("silence", "name", "long pause"), ("silence", "nested.mode", "review"), ("silence", "threshold", "3.0")]


def test_match_ladder_of_all_sentences(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r["rec_id"], r["sent_idx"]): (r["match"], r["n_common"]) for r in catalogue.queries()["text_match_ladder"](spark, sf).collect()}
    text = {(r["rec_id"], r["sent_idx"]): r["text"] for r in sequence.sentences(sequence.timeline(spark.read.parquet(f"{sf}/conversations.parquet"))).collect()}
    pairs = {k: (a, text[k[0], k[1] + 1]) for k, a in text.items() if (k[0], k[1] + 1) in text}
    assert set(got) == set(pairs)
    for k in sorted(got)[::23]:
        a, b = pairs[k]
        n = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)
        rung = "exact" if a == b else "contained" if a in b or b in a else "common" if 2 * n >= min(len(a), len(b)) else "none"
        assert got[k] == (rung, n)
