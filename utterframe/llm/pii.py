"""Personal data by weak supervision.

Candidates are spans of four kinds: those of fixed patterns (the base) and looser ones (numbers
without a plus sign, spelled-out addresses, shorter cards).  Labelers vote on each: the strict
pattern, a gazetteer (top-level domains, issuers, area codes, address ranges), cue words in the
context, the boundaries, and personal data close by.  Expectation-maximisation estimates how
reliable each labeler is from the counts of vote patterns, which are few however many spans there
are.  The posteriors are the soft labels of a final logistic classifier of each kind of span.  It does
not see the votes: its features are the shape of the span's characters, the characters beside it, and
the words before and after.  It admits or rejects the looser spans; base spans always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterframe.durable import durable
from utterframe.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "boundary", "company")
#: Votes: 0 against, 1 abstains, 2 for.
AGAINST, ABSTAIN, FOR = 0, 1, 2
#: Posterior at which a looser span is admitted.
ADMIT = 0.9
EM_ROUNDS = 50
CONTEXT, COMPANY = 40, 200

# Gazetteers and cue words.
TOP_LEVEL = frozenset("com net org edu gov mil int info biz io co ai app dev eu de fr es it nl be at ch uk us ca au jp cn in br mx se no dk fi pl pt ie ru".split())
CUES = {
    "email": frozenset("email mail e-mail contact write correo courriel address".split()),
    "ip": frozenset("ip ipv4 host server address addr client remote".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax ring telefon téléphone teléfono".split()),
}
ANTI_CUES = frozenset("version v isbn issn sha hash order invoice section chapter figure page release build".split())

# The base patterns; possessive forms where the greedy one cannot give back, so that long runs cost linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Looser forms.
SPELLED = re.compile(r"([A-Za-z0-9_%+-]{1,64}(?:\.[A-Za-z0-9_%+-]{1,64}){0,8}) ?(?:\(at\)|\[at\]|\{at\}| at ) ?([A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}){1,8})(?![A-Za-z0-9])", re.I)
DOTS = ("(dot)", "[dot]", "{dot}", " dot ", "(DOT)", "[DOT]", " DOT ", "(at)", "[at]", "{at}", "(AT)", "[AT]")
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}(?:\[\.\]|\(\.\)| dot |\.)[0-9]{1,3}(?:\[\.\]|\(\.\)| dot |\.)[0-9]{1,3}(?![0-9])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])")
PLAIN_CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:(?:00|\+)[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

Span = tuple[str, int, int]

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Values of the classifier's features: hashed shape, characters on both sides, hashed word before (0: none), and after.
SIZES = (256, 16, 64, 32)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping; found from each ``@`` outwards, so that long runs without one cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and LOCAL.match(text[a - 1]):
            a -= 1
        end = at + 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            last = end = m.end()
        elif a < at:
            last = at + 1
        at = text.find("@", end)
    return out


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans by kind then start, and the matches that failed their check."""
    good, bad = emails(text) if "@" in text else [], []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            fine = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
            (good if fine else bad).append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start():
                d = digits_of(m.group())
                if 16 <= len(d) <= 19:
                    (good if luhn(d) else bad).append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                (good if 8 <= len(digits_of(m.group())) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def loose_spans(text: str, good: list[Span], bad: list[Span]) -> list[Span]:
    """Looser candidates that overlap no base span and none before them.

    A match that failed its check is not tried again as a whole; a phone number or card number that
    a failed match has run together with other digits is a candidate of its own.
    """
    taken = good + [s for s in bad if s[0] == "ip"]
    failed = {(a, b) for kind, a, b in bad if kind == "card"}
    found = [("card", a + m.start(), a + m.end()) for a, b in sorted(failed) for m in PLAIN_CARD.finditer(text[a:b]) if m.span() != (0, b - a) and luhn(m.group())]
    if any(d in text for d in DOTS):
        found += [("email", *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in LOOSE_IP.finditer(text)]
        found += [("card", *m.span()) for m in LOOSE_CARD.finditer(text) if not any(m.start() < b and a < m.end() for a, b in failed)]
        found += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
    if not found:
        return []
    used = sorted((a, b) for _, a, b in taken)
    starts, reach, last, out = [a for a, _ in used], list(accumulate((b for _, b in used), max)), 0, []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        i = bisect_left(starts, b)
        if last <= a and (not i or reach[i - 1] <= a):
            out.append((kind, a, b))
            last = b
    return out


def votes(text: str, span: Span, strict: bool | None, others: np.ndarray) -> str:
    """The labelers' votes on a span; ``strict``: passed or failed its base pattern, or None; ``others``: sorted starts of base spans."""
    kind, a, b = span
    body, d = text[a:b], digits_of(text[a:b])
    v = [ABSTAIN if strict is None else FOR if strict else AGAINST]
    if kind == "email":
        v.append(FOR if re.split(r"[^a-z]+", body.lower().rstrip(")]}"))[-1] in TOP_LEVEL else AGAINST)
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", body)
        v.append(FOR if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 and str(int(p)) == p for p in parts) and 0 < int(parts[0]) < 224 else AGAINST)
    elif kind == "card":
        issuer = d[0] == "4" or "51" <= d[:2] <= "55" or d[:2] in ("34", "37", "36", "38", "65") or d[:4] == "6011" or "2221" <= d[:4] <= "2720" or d[:2] == "35"
        v.append(FOR if issuer and luhn(d) else AGAINST)
    else:
        n = d.removeprefix("00") if body[0] != "+" else d
        area = n[-10:-7]
        v.append(FOR if len(n) >= 10 and area[:1] >= "2" else ABSTAIN if strict else AGAINST)
    before = WORD.findall(text[max(0, a - CONTEXT) : a].lower())[-5:]
    v.append(FOR if CUES[kind].intersection(before) else AGAINST if ANTI_CUES.intersection(before) else ABSTAIN)
    left, right = text[a - 1 : a], text[b : b + 1]
    v.append(FOR if not (left.isalnum() or left in ("_", "#", "/", "=")) and not (right.isalnum() or right in ("_", "/")) else AGAINST)
    i = np.searchsorted(others, a - COMPANY)
    near = others[i : i + 3]
    v.append(FOR if any(x != a and x <= b + COMPANY for x in near.tolist()) else ABSTAIN)
    return "".join(map(str, v))


def shape(body: str) -> str:
    """The characters of a span by class: ``9`` digits, ``a`` letters, others as they are; runs of letters shortened, runs of digits up to four kept."""
    classes = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in body[:200])
    return re.sub("9{5,}", "99999", re.sub("a+", "a", classes))


def features(text: str, span: Span) -> tuple[int, ...]:
    """What the classifier sees of a span, each feature as one of SIZES values."""
    _, a, b = span
    near = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    before = WORD.findall(text[max(0, a - CONTEXT) : a].lower())[-1:]
    after = WORD.findall(text[b : b + CONTEXT].lower())[:1]
    hashed = lambda w, n: crc32(w.encode()) % (n - 1) + 1
    return hashed(shape(text[a:b]), SIZES[0] + 1) - 1, near(text[a - 1 : a]) * 4 + near(text[b : b + 1]), hashed(before[0], SIZES[2]) if before else 0, hashed(after[0], SIZES[3]) if after else 0


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, candidates)`` of each row: spans ``kind, a, b``, and with candidates their votes, features and whether they are base."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.string()), ("f", pa.list_(pa.int32())), ("base", pa.bool_())])
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    text = text or ""
                    good, bad = base_spans(text)
                    loose = loose_spans(text, good, bad)
                    others = np.array(sorted(a for _, a, _ in good), dtype=np.int64)
                    rows.append([{"kind": s[0], "a": s[1], "b": s[2], "votes": votes(text, s, strict, others), "f": features(text, s), "base": bool(strict)} for group, strict in ((good, True), (bad, False), (loose, None)) for s in group])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, spans array<struct<kind:string,a:bigint,b:bigint,votes:string,f:array<int>,base:boolean>>"
    )


def reliabilities(patterns: list[tuple[str, int]], rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM on counted vote patterns of one kind: prior, P(vote | class, not abstaining) by labeler, posterior of each pattern.

    Starts from the share of votes for among the votes cast, so that class 1 is the one voted for.
    """
    votes_, n = np.array([[int(c) for c in p] for p, _ in patterns]), np.array([c for _, c in patterns], dtype=float)
    cast = np.maximum(1, (votes_ != ABSTAIN).sum(axis=1))
    post = np.clip((votes_ == FOR).sum(axis=1) / cast, 0.05, 0.95)
    prior, table = 0.5, np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        prior = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        for k in range(len(LABELERS)):
            for y, w in ((0, 1 - post), (1, post)):
                hits = np.array([(n * w)[votes_[:, k] == v].sum() for v in (AGAINST, FOR)])
                # a weak belief that labelers are better than chance, on both classes
                hits = hits + (np.array([2.0, 0.5]) if y == 0 else np.array([0.5, 2.0]))
                # to abstain says nothing about the class
                table[k, y, [AGAINST, FOR]] = hits / hits.sum()
        table[:, :, ABSTAIN] = 1
        log = np.log([1 - prior, prior]) + np.stack([np.log(table[np.arange(len(LABELERS)), y, votes_]).sum(axis=1) for y in (0, 1)], axis=1)
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return prior, table, {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def classifier(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray, steps: int = 60, penalty: float = 0.1) -> list[np.ndarray]:
    """Logistic regression on one-hot features (a column each), trained on soft labels: a weight for each value of each feature, the constant last."""
    offsets = np.concatenate(([0], np.cumsum(SIZES)))
    x = np.concatenate([rows + offsets[:-1], np.full((len(rows), 1), offsets[-1])], axis=1)
    used, x = np.unique(x, return_inverse=True)  # values that do not occur keep weight 0
    x, size, n = x.reshape(len(rows), -1), len(used), np.log1p(counts)
    w = np.zeros(size)
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g, h = penalty * w, penalty * np.eye(size)
        for i in x.T:
            g = g + np.bincount(i, n * (p - labels), minlength=size)
            for j in x.T:
                h += np.bincount(i * size + j, n * p * (1 - p), minlength=size * size).reshape(size, size)
        w -= np.linalg.solve(h, g)
    full = np.zeros(offsets[-1] + 1)
    full[used] = w
    return [full[a:b] for a, b in zip(offsets, [*offsets[1:], len(full)], strict=True)]


def posteriors(patterns: list[tuple[str, str, int]]) -> dict[str, dict[str, float]]:
    """By kind, from ``(kind, votes, count)``, the posterior of each vote pattern."""
    by = defaultdict(list)
    for kind, v, n in sorted(patterns):
        by[kind].append((v, n))
    return {kind: reliabilities(rows)[2] for kind, rows in by.items()}


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", admit: float = ADMIT) -> DataFrame:
    """``(id, base, spans, added)``: arrays of ``kind, a, b`` (code points, end exclusive) by kind as in KINDS, then start; a row for each row of ``docs``.

    ``base`` has the fixed patterns' spans; ``spans`` also those that the method admits, ``added`` of
    them.  A span that matched a base pattern and failed its check is never admitted.  Null and empty
    texts have none.  Texts are scanned whole, whatever their length; repeated rows and null ids are
    kept; other columns are left out; no rows give no rows.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        rows = durable(extract(docs, id_col, text_col))
    every = rows.select(F.explode("spans").alias("s")).select("s.*")
    patterns = every.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # bounded: kinds x vote patterns
    post = posteriors([(r["kind"], r["votes"], r["n"]) for r in patterns])
    soft = spark.createDataFrame([(k, v, float(p)) for k, ps in post.items() for v, p in ps.items()], "kind string, votes string, p double")
    # bounded: kinds x values of the features
    sums = every.join(F.broadcast(soft), ["kind", "votes"]).groupBy("kind", "f").agg(F.sum("p").alias("p"), F.count("*").alias("n")).orderBy("kind", "f").toArrow()
    models = {}
    for kind in KINDS:
        t = sums.filter(pc.equal(sums["kind"], kind))
        if len(t):
            n = t["n"].to_numpy().astype(float)
            models[kind] = classifier(np.array(t["f"].to_pylist(), np.int64), np.clip(t["p"].to_numpy() / n, 0, 1), n)

    def logit(s: Column) -> Column:
        out = F.lit(-np.inf)
        for kind, (*weights, constant) in models.items():
            of = sum((F.get(F.lit(w), s["f"][i]) for i, w in enumerate(weights)), F.lit(float(constant[0])))
            out = F.when(s["kind"] == kind, of).otherwise(out)
        return out

    least = log(admit / (1 - admit))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ok = lambda s: s["base"] | ((F.substring(s["votes"], 1, 1) == str(ABSTAIN)) & (logit(s) >= least))
    sort = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("k"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), s["b"].alias("b")))
    out = rows.select("id", sort(F.filter("spans", lambda s: s["base"])).alias("base"), sort(F.filter("spans", ok)).alias("spans"))
    return out.withColumn("added", (F.size("spans") - F.size("base")).cast("bigint"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
