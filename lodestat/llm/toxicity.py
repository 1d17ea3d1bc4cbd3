"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, with extreme-value calibration.

Training. Words are counted by documents of both labels, and the character runs inside words (their ends marked) by the words that hold
them, so that inflected forms of a stem count together wherever the stem stands. Log-odds have a Dirichlet prior in proportion to the
overall counts. A feature speaks for label 1 if its log-odds exceed ``LEAST`` by a likelihood ratio that chance would
give to few (``FALSE``) of all features; a run must also come from several words, speak for label 1 by the number of words as well, and one that is hardly ever seen outside a longer run
gives way to that. A token scores its own log-odds if they are sure,
else the best of its features, a small negative drift if it has none, so that a random text's running sum
falls. Scoring. One scan finds all maximal segments of positive sum of a text (Ruzzo and Tompa). The sums of segments in text without
toxicity follow an extreme-value law: lambda is the root of the scores' generating function, K comes from the segments of clean
calibration texts. A text's evidence is the sum of lambda * S - ln(K * n) over its significant segments; a logistic curve on texts that
the log-odds have not seen turns it into a probability; texts without evidence have theirs, the share that was labelled all the same. The log-odds used in the end are those of all rows.

Which labelled rows. At most ``SAMPLE`` of each label, those of the smallest md5 of the id, are used to fit; rows of other ids are
counted for nothing but the score. A document with several labels is toxic if any label says so; null labels do not count. The curve
weights each label's rows by how many labelled rows stand behind one that was taken, so that a full label moves no probability.

Scoring reads the text alone. A null or empty text, or one without letters and digits, has no segment and gets the score of no
evidence. Without labelled rows of both kinds every text gets score 0. Repeated rows are scored each; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import in_small_batches, stage, text_of, texts

#: Labelled rows of each label that are used to fit, at most.
SAMPLE = 20_000
WORD = re.compile(r"[^\W_]+")
#: Lengths of character runs; a word's ends count as characters.
RUNS = (4, 5, 6)
#: Distinct words of label 1 that a run must come from.
WORDS_LEAST = 3
PRIOR = 200.0
PRIOR_LEAST = 2.0
#: Log-odds that a feature must surely exceed: a language or a subject that toxic texts prefer is not toxic for it.
LEAST = 0.5
#: Features that chance may let through.
FALSE = 5.0
#: A run gives way to a longer one that has so much of its count.
HELD = 0.9
DRIFT = 0.05
#: A feature scores the end of its log-odds' interval that lies so many standard deviations down.
SURE = 2.0
#: A segment counts if at most so many as good ones are expected in a clean text of its length.
EXPECTED = 0.5
#: Words a worker remembers the score of; bounds its memory, never its results.
WORDS_KEPT = 200_000


def runs_of(word: str) -> set[str]:
    """The character runs of a word, ``<`` and ``>`` being its ends."""
    w = f"<{word}>"
    return {w[i:i + n] for n in RUNS for i in range(len(w) - n + 1)}


def features(word: str) -> list[str]:
    """The word, and what it may share with others: runs, and the words it begins with."""
    return [word, *runs_of(word), *(word[:n] + "*" for n in range(4, len(word) + 1))]


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of every labelled document that is not held out."""
    per = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return per.where(~held_out())


def weights(labels: DataFrame, sample: int = SAMPLE) -> tuple[float, float]:
    """Labelled rows of labels 0 and 1 that one row of the sample stands for."""
    n = {r[0]: r[1] for r in known(labels).groupBy("toxic").count().collect()}
    return tuple(n.get(k, 0) / sample if n.get(k, 0) > sample else 1.0 for k in (0, 1))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, key, later, text) of the labelled rows to fit with. The labels chosen are few enough to be broadcast."""
    per = known(labels).withColumn("_at", F.md5(F.col("doc_id").cast("string")))
    some = [per.where(F.col("toxic") == k).orderBy("_at", "doc_id").limit(sample) for k in (0, 1)]
    chosen = stage(some[0].unionByName(some[1]), "labels")
    rows = text_of(docs, "doc_id").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in texts(b):
                key = np.fromiter(map(likeness, some), np.int64, len(some))
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(first, len(some)), pa.array(key), pa.array(key * 0x9E3779B1 >> 16 & 3 == 0), pa.array(some, pa.string())],
                                                 names=["toxic", "key", "later", "text"])

    return rows.mapInArrow(run, "toxic int, key long, later boolean, text string")


def likeness(text: str) -> int:
    """The least hash of a text's five-word shingles: that of a near copy as a rule, so that copies stay in one fold and count once."""
    words = WORD.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(max(1, len(words) - 4))))


#: Columns of counts: documents of both labels, and those of them that are not kept for the curve.
COUNTS = ("n0", "n1", "early0", "early1")


def _counted(total: dict[str, list[int]], *names: str) -> pa.RecordBatch:
    n = np.asarray(list(total.values()), np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array(n[:, i]) for i in range(len(names)))], names=["feature", *names])


def _summed(rows: DataFrame, *names: str) -> DataFrame:
    return rows.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names))


def word_counts(rows: DataFrame) -> DataFrame:
    """(feature, *COUNTS): documents that hold the word, copies once; tasks sum first. The row of "" counts all words of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, later = b.column("toxic").to_pylist(), b.column("later").to_pylist()
            for first, some in texts(b):
                total: dict[str, list[int]] = {"": [0, 0, 0, 0]}
                for label, late, text in zip(toxic[first:], later[first:], some, strict=False):
                    words = set(WORD.findall(text.lower()))
                    at = (label,) if late else (label, 2 + label)
                    for i in at:
                        total[""][i] += len(words)
                    for w in words:
                        own = total.get(w)
                        if own is None:
                            own = total[w] = [0, 0, 0, 0]
                        for i in at:
                            own[i] += 1
                yield _counted(total, *COUNTS)

    different = rows.dropDuplicates(["toxic", "key"]).select("toxic", "later", "text")
    return _summed(different.mapInArrow(run, "feature string, " + ", ".join(f"{c} long" for c in COUNTS)), *COUNTS)


def run_counts(words: DataFrame) -> DataFrame:
    """(feature, *COUNTS, words0, words1): the counts of the words that hold the run, and how many different words of each label do. The
    row of "" counts all words."""
    names = (*COUNTS, "words0", "words1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, list[int]] = {}
            for w, *n in zip(*(b.column(c).to_pylist() for c in ("feature", *COUNTS)), strict=True):
                n += [int(n[0] > 0), int(n[1] > 0)]
                for f in ("", *runs_of(w)):
                    own = total.get(f)
                    total[f] = n if own is None else [x + y for x, y in zip(own, n, strict=True)]
            yield _counted(total, *names)

    return _summed(words.where("feature != ''").mapInArrow(run, "feature string, " + ", ".join(f"{c} long" for c in names)), *names)


def log_odds(words: DataFrame, runs: DataFrame, of: tuple[str, str]) -> dict[str, float]:
    """Features that speak for label 1, with the lower end of their log-odds; ``of`` names the counts. Their number follows the bounded sample."""
    all_ = words.where("feature = ''").first()
    if all_ is None or not all_[of[0]] or not all_[of[1]]:
        return {}
    totals = [float(all_[c]) for c in of]
    kinds = runs.where("feature = ''").first()
    whole = sum(totals)
    a = F.lit(PRIOR_LEAST) + F.lit(PRIOR) * (F.col(of[0]) + F.col(of[1])) / whole
    seen = [F.col(c) + a * (t / whole) for c, t in zip(of, totals, strict=True)]
    odds = F.log(seen[1] / (totals[1] + PRIOR)) - F.log(seen[0] / (totals[0] + PRIOR))
    n = words.where(F.col(of[0]) + F.col(of[1]) > 0).count() + runs.where(F.col(of[0]) + F.col(of[1]) > 0).count()
    # twice the log-likelihood ratio against log-odds of LEAST
    share = totals[1] * math.exp(LEAST) / (totals[0] + totals[1] * math.exp(LEAST))
    both = F.col(of[0]) + F.col(of[1])
    parts = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0) for c, p in zip(of, (1 - share, share), strict=True)]
    sure = (F.col(of[1]) > both * share) & (parts[0] + parts[1] > math.log(max(n / FALSE, 2.0)))
    kept = [x.select("feature", F.col(of[1]).alias("n"), (odds - SURE * F.sqrt(1 / seen[0] + 1 / seen[1])).alias("odds")).where(sure & (F.col("odds") > 0))
            for x in (words.where("feature != ''"), runs.where((F.col("words1") >= WORDS_LEAST) & (F.col("words1") * kinds["words0"] > math.exp(LEAST) * F.col("words0") * kinds["words1"])))]
    found = [{r["feature"]: (r["n"], r["odds"]) for r in x.collect()} for x in kept]
    longer = dict.fromkeys(found[1], 0)       # the largest count of a run that is longer by a character
    for f, (count, _) in found[1].items():
        for shorter in (f[1:], f[:-1]):
            if shorter in longer:
                longer[shorter] = max(longer[shorter], count)
    out = {f: o for f, (count, o) in found[1].items() if longer[f] < HELD * count}
    out |= {w: o for w, (_, o) in found[0].items()} | {w + "*": o for w, (_, o) in found[0].items() if len(w) >= 4}
    # words that are seen too often in clean texts to be toxic for what they share with others
    clean = words.where("feature != ''").select("feature", (odds + 2 * F.sqrt(1 / seen[0] + 1 / seen[1])).alias("most")).where(F.col("most") < LEAST)

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([w not in out and any(f in out for f in features(w)) for w in b.column("feature").to_pylist()], pa.bool_()))

    return out | {r[0]: 0.0 for r in clean.select("feature").mapInArrow(sharing, "feature string").collect()}


class Scorer:
    """Token scores of texts and their maximal segments."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.known = odds, {}

    def tokens(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > WORDS_KEPT:
                self.known = {}
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    own = self.odds.get(w)
                    found[i] = self.known[w] = (max(self.odds.get(f, 0.0) for f in features(w)) if own is None else own) or -DRIFT
        return np.asarray(found, float)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, sum) of positive sum, in order. Runs of one sign are taken together first: a maximal segment
    never starts or ends within one. Each candidate is joined with earlier ones until none before it starts lower and ends lower."""
    if not len(scores) or scores.max() <= 0:
        return []
    sign = scores > 0
    cuts = np.concatenate([[0], np.flatnonzero(sign[1:] != sign[:-1]) + 1, [len(scores)]])
    sums = np.add.reduceat(scores, cuts[:-1])
    total, held = 0.0, []       # (start, end, sum before, sum after, place of the last one that starts lower)
    for a, b, x in zip(cuts[:-1].tolist(), cuts[1:].tolist(), sums.tolist(), strict=True):
        before, total = total, total + x
        if x <= 0:
            continue
        start, left, right = a, before, total
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
            j -= 1
        held.append((start, b, left, right, j))
    return [(a, b, r - le) for a, b, le, r, _ in held]


class Model:
    """Log-odds, the extreme-value law's lambda and K, the logistic curve's two coefficients and the probability without evidence."""

    def __init__(self, odds: dict[str, float], rate: float, k: float, curve: tuple[float, float, float] | None):
        self.odds, self.rate, self.k, self.curve = odds, rate, k, curve

    def significant(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """(start, end, lambda * S - ln(K * n)) of the segments that are significant at this length."""
        cut = math.log(max(self.k * len(scores), 1e-9))
        found = ((a, b, self.rate * s - cut) for a, b, s in maximal_segments(scores))
        return [x for x in found if x[2] >= -math.log(EXPECTED)]

    def probability(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        if not evidence:
            return self.curve[2]
        z = self.curve[0] + self.curve[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-min(max(z, -40), 40)))


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weight * exp(rate * value)) = 1; the values' mean is negative."""
    p = weights / weights.sum()
    if values.max() <= 0:
        return 1.0
    if (p * values).sum() >= 0:
        return 0.05
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * values, 500))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 500))).sum() < 1 else (low, mid)
    return max(high, 0.05)


def _curve(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value with counts, by Newton steps with a light penalty."""
    w = np.zeros(2)
    f = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ f, -30, 30)))
        g = f @ (n1 - (n0 + n1) * p) - 1e-2 * w
        h = (f * ((n0 + n1) * p * (1 - p))) @ f.T + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -5, 5)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = stage(labelled(docs, labels, sample), "labelled")
    words = stage(word_counts(rows), "words")
    runs = stage(run_counts(words), "character-runs")
    odds = log_odds(words, runs, ("early0", "early1"))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Token scores of the clean texts that the odds come from, in steps of 1/64."""
        scorer, total = Scorer(odds), {}
        for b in batches:
            for _, some in texts(b):
                for text in some:
                    for v, n in zip(*np.unique(np.round(scorer.tokens(text) * 64), return_counts=True), strict=True):
                        total[int(v)] = total.get(int(v), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["step", "n"])

    clean = rows.where("toxic = 0 AND NOT later").select("text")
    steps = clean.mapInArrow(histogram, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    values = np.asarray([[r[0] / 64, r[1]] for r in steps] or [[-DRIFT, 1.0]], float).T
    # a finer value for the many tokens of the drift itself
    values[0] = np.where(values[0] < 0, -DRIFT, values[0])
    rate = _rate(values[0], values[1])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """exp(lambda * S) sums would follow one outlier; so: segments of at least one nat, and tokens, of clean later texts."""
        scorer, n, tokens = Scorer(odds), 0, 0
        for b in batches:
            for _, some in texts(b):
                for text in some:
                    s = scorer.tokens(text)
                    tokens += len(s)
                    n += sum(rate * x >= 1 for _, _, x in maximal_segments(s))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], names=["n", "tokens"])

    got = rows.where("toxic = 0 AND later").select("text").mapInArrow(segments, "n long, tokens long").agg(F.sum("n"), F.sum("tokens")).first()
    k = (float(got[0] or 0) + 0.5) * math.e / (float(got[1] or 0) + 1.0)
    model = Model(odds, rate, k, None)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, total = Scorer(odds), {}
        for b in batches:
            toxic = b.column("toxic").to_pylist()
            for first, some in texts(b):
                for label, text in zip(toxic[first:], some, strict=False):
                    x = round(math.log1p(sum(e for _, _, e in model.significant(scorer.tokens(text)))) * 32)
                    total.setdefault(x, [0, 0])[label] += 1
        n = np.asarray(list(total.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["x", "n0", "n1"])

    seen = rows.where("later").select("toxic", "text").mapInArrow(evidence, "x long, n0 long, n1 long").groupBy("x").agg(F.sum("n0"), F.sum("n1")).collect()
    if odds and seen:
        x, n0, n1 = np.asarray([tuple(r) for r in seen], float).T
        if n0.sum() and n1.sum():
            w0, w1 = weights(labels, sample)
            n0, n1, some = n0 * w0, n1 * w1, x > 0
            none = (n1[~some].sum() + 0.5 * w1) / (n0[~some].sum() + n1[~some].sum() + w0 + w1)
            model.curve = (*_curve(x[some] / 32, n0[some], n1[some]), min(float(none), 0.49))
            model.odds = log_odds(words, runs, ("n0", "n1"))
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), with_segments: bool = False) -> DataFrame:
    """The kept columns, score and predicted; with segments also (first word, word after the last, evidence) of each toxic passage."""
    source = text_of(docs.select(*keep, F.col("text").alias("_scored")), *keep, text="_scored")
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    spot = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.odds)
        for b in batches:
            for first, some in texts(b):
                found = [model.significant(scorer.tokens(t)) for t in some]
                p = np.asarray([model.probability(sum(e for _, _, e in x)) for x in found], float)
                cols = [*(b.column(c).slice(first, len(some)) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                if with_segments:
                    cols.append(pa.array([[dict(zip(("first", "after", "evidence"), s, strict=True)) for s in x] for x in found], spot))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "predicted", *["segments"] * with_segments])

    return source.mapInArrow(run, f"{kinds}, score double, predicted int" + ", segments array<struct<first int, after int, evidence double>>" * with_segments)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.odds)
        for b in batches:
            keep: list[bool] = []
            for _, some in texts(b):
                keep += [model.probability(sum(e for _, _, e in model.significant(scorer.tokens(t or "")))) < 0.5 for t in some]
            yield b.filter(pa.array(keep, pa.bool_()))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
