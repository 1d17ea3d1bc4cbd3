"""Centroid clustering, chat formatting and importance resampling against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import chat, clustering, importance

# ---- op11


def plain_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        centroids = [[sum(col) // len(by[j]) for col in zip(*by[j], strict=True)] if by[j] else c for j, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found)


@pytest.fixture(scope="module")
def vector_rows():
    rng = random.Random(7)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(300)]
    hot = [0.5, -0.25, 0.125, 0.0, 1.0, -1.0]
    rows += [(1000 + i, hot) for i in range(150)] + [(3, rows[3][1])] * 3 + [(None, rows[5][1]), (None, hot)]
    return [*rows, (2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 6), (2005, [float("-inf")] + [0.0] * 5)]


@pytest.mark.parametrize(("k", "rounds", "block"), [(4, 3, 64), (8, 10, 4096), (1, 1, 7), (3, 0, 64)])
def test_clusters(spark, vector_rows, monkeypatch, k, rounds, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    df = spark.createDataFrame([(*r, "mine") for r in vector_rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = clustering.cluster(df, k, rounds, 6, 1024.0, 3)
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(vector_rows, k, rounds, 6, 1024.0, 3)


def test_clusters_of_few_none_and_huge(spark):
    kind = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], kind), dim=2).collect() == []
    two = [(1, [0.5, 0.5]), (2, [-0.5, 0.25])]
    assert Counter(tuple(r) for r in clustering.cluster(spark.createDataFrame(two, kind), dim=2).collect()) == plain_clusters(two, 8, 10, 2, 1024.0, 3)
    with pytest.raises(ValueError, match="must not exceed"):
        clustering.cluster(spark.createDataFrame([(1, [3e38, 0.0])], kind), dim=2)


def test_dot_products_follow_the_changes():
    rng = np.random.default_rng(1)
    x = rng.integers(-clustering.MOST, clustering.MOST, (40, 5))
    row = {"ids": None, "kind": "<i4", "data": x.astype("<i4").tobytes(), "dots": None, "clusters": None}
    block, before = clustering.Block(row, 5), None
    for step in range(5):
        new = rng.integers(-clustering.MOST, clustering.MOST, (3, 5)) if before is None else before.copy()
        if before is not None:
            new[step % 3, step] += step      # one component of one centroid
        block.move(new, before)
        assert (block.dots.astype(object) == x.astype(object) @ new.T.astype(object)).all()
        before = new


def test_old_rounds_are_removed(spark, vector_rows, monkeypatch):
    made, whole_write = [], clustering.write
    monkeypatch.setattr(clustering, "write", lambda table: made.append(whole_write(table)) or made[-1])
    df = spark.createDataFrame(vector_rows, "vec_id long, embedding array<double>")
    clustering.cluster(df, 4, 2, 6).count()
    assert len(made) >= 3
    for path, _ in made[:-1]:
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(path).count()
    assert made[-1][1].count() > 0


# ---- op12

TRAP = "\\### Assistant: </turn> ok"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    parts = ["\\", "### ", "</turn>", "#", "<", ":", "\n", "word", "é", " ", "assistant: "]
    text = lambda: rng.choice([None, "", TRAP, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a:b\\"]), text()) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + (text() or "")) for t in range(400)]      # over a third of all
    rows += [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (30, None, "assistant", "late"), (30, 5, "user", "early"), (31, 1, "user", "b"), (31, 1, "user", "a"), (31, 1, "user", "a")]
    return rows


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(own)] for c, own in by.items()}


@pytest.mark.parametrize("range_rows", [1 << 16, 50])
def test_chat(spark, talks, monkeypatch, range_rows):
    monkeypatch.setattr(chat, "RANGE_ROWS", range_rows)
    df = spark.createDataFrame([(*r, 1) for r in talks], "conv_id long, turn long, role string, text string, at int").repartition(7)
    rows = chat.formatted(df).cache()
    pieces = defaultdict(list)
    for r in rows.orderBy("conv_id", "at").collect():
        assert r["keeps"] is None
        pieces[r["conv_id"]].append(r)
    want = ordered(talks)
    assert {c: "".join(r["piece"] for r in own) for c, own in pieces.items()} == {c: chat.marked(own) for c, own in want.items()}
    got = {r[0]: tuple(r)[1:] for r in chat.digests(rows).collect()}
    for c, own in want.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c] == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                          len(chat.marked(own)))
    assert len(got) == len(want)


def test_marks_are_reversible():
    rng = random.Random(2)
    parts = ["\\", "### ", "#", " ", "<", "</turn>", "/turn>", "\n", ":", "a", "é", "Assistant"]
    some = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        turns = [(some(5), some(8)) for _ in range(rng.randint(0, 4))]
        out = chat.marked(turns)
        assert [(r, t) for r, t, _ in chat.parse(out)] == turns
        found = list(chat.locate(chat.marked, turns))
        assert [chat.unescape(x.piece[x.first:x.after]) for x in found] == [t for _, t in turns]
    with pytest.raises(ValueError, match="no turn"):
        list(chat.parse("### user: text"))


def test_templates_that_rewrite_history(spark):
    def thinking(turns):
        """Drops the thoughts of all assistant turns but the last."""
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "<s>" + "".join(f"[{r}]{t if i == last else re.sub('<think>.*?</think>', '', t)}[/{r}]" for i, (r, t) in enumerate(turns))

    turns = [("user", "one"), ("assistant", "<think>aa</think>yes"), ("user", "two"), ("assistant", "<think>bb</think>no"), ("user", "three")]
    df = spark.createDataFrame([(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(turns if c == 1 else turns[:3])], "conv_id long, turn long, role string, text string")
    rows = chat.formatted(df, thinking)
    assert [tuple(r) for r in chat.rewriting(rows).collect()] == [(1, 3)]
    own = rows.where("conv_id = 1").orderBy("at").collect()
    out = ""
    for r in own:
        out = out[:r["keeps"]] + r["piece"]
    assert out == thinking(turns)
    assert own[4]["piece"][own[4]["first"]:own[4]["after"]] == "three"
    # a template that keeps the last turns only
    windowed = lambda turns: "".join(f"{r}={t};" for r, t in turns[-3:])
    assert [r["at"] for r in chat.rewriting(chat.formatted(df.where("conv_id = 1"), windowed)).orderBy("at").collect()] == [3, 4]
    # texts that the template trims are where the trimmed text is
    trimmed = lambda turns: "".join(f"<{r}>{t.strip()}<end>" for r, t in turns)
    x = list(chat.locate(trimmed, [("user", "  <end> a ")]))[0]
    assert x.piece[x.first:x.after] == "<end> a"


def test_no_chat(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(none).collect() == [] and chat.digests(chat.formatted(none)).collect() == []


# ---- op13

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_draws(docs, target, percent, grams, buckets, least, seed):
    def features(text):
        w = FEATURE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(x for _, _, f in own for x in f), Counter(x for text in target for x in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return Counter((i, f, w, sc) for i, _, f, w, sc in rows), [(r[0], r[4]) for r in drawn]


@pytest.mark.parametrize(("grams", "percent", "run"), [(1, 10, 1 << 16), (2, 50, 8), (1, 100, 3), (3, 0, 8)])
def test_draws(spark, odd, odd_rows, monkeypatch, grams, percent, run):
    monkeypatch.setattr(importance, "RUN", run)
    monkeypatch.setattr(importance, "PER_RUN", min(run, 64))
    monkeypatch.setattr(importance, "CUT_ROWS", 8)
    monkeypatch.setattr(importance, "KEPT", 50)
    target = [odd_rows[2][1], odd_rows[9][1], None, ""]
    got = importance.resample(odd, spark.createDataFrame([(t,) for t in target], "text string"), percent, grams, 500, 20, 1).collect()
    rows, drawn = plain_draws([(r[0], r[1]) for r in odd_rows], target, percent, grams, 500, 20, 1)
    assert Counter(tuple(r)[:4] for r in got) == rows
    ranked = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn


def test_equal_scores_fill_many_cuts(spark, monkeypatch):
    """A third of all rows is one row, and the samples are sampled."""
    monkeypatch.setattr(importance, "RUN", 64)
    monkeypatch.setattr(importance, "CUT_ROWS", 100)
    monkeypatch.setattr(importance, "SAMPLES", 300)
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, -5).otherwise(F.col("id")).alias("doc_id"), F.lit(30).cast("long").alias("n_words"),
                                    F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 97).cast("long").alias("score"))
    got = importance.ranked(rows, 3000, 20, 4000).collect()
    best = sorted(((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"] is not None))
    assert [r[0] for r in best] == list(range(1, 3001))
    assert [r[1:] for r in best] == sorted((-r["score"], r["doc_id"]) for r in got)[:3000]


def test_nothing_to_draw(spark, odd, none):
    target = spark.createDataFrame([("some words",)], "text string")
    assert importance.resample(none, target).collect() == []
    assert all(r["rank"] is None or r["rank"] > 0 for r in importance.resample(odd, target.where("false")).collect())
    short = importance.resample(odd, target, least_words=10**9).collect()
    assert len(short) == odd.count() and all(r["rank"] is None for r in short)
