"""The pipeline's stages on odd rows, and the registered queries on the smallest tables."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodestat.llm import paragraphs
from lodestat.llm.common import stage
from tests.llm.test_operators import WORD, brute_classes, brute_fingerprint, crc, ids_of
from tools import check

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, odd, odd_rows, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, i % 2) for i, r in enumerate(odd_rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, folder), name)
        if name != "pack":
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        seen.append(docs)
    clean, single, redacted, mix, packed = seen[1:]
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert not Counter(rows) - Counter((r["doc_id"], r["text"]) for r in first.collect())
    classes = brute_classes([brute_fingerprint(t) for _, t in rows])
    kept = [brute_fingerprint(r["text"]) for r in single.collect()]
    assert len(kept) == len(set(classes))
    assert redacted.count() == single.count() and not any(re.search("AKIA[A-Z0-9]{16}", r["text"] or "") for r in redacted.collect())
    words = sum(len(WORD.findall(r["text"] or "")) for r in redacted.collect())
    assert abs(sum(len(WORD.findall(r["text"])) for r in mix.collect()) - 1.5 * words) <= 10
    want = Counter((r["doc_id"], crc(ids[-min(len(ids), 1024):])) for r, ids in zip(mix.collect(), ids_of([r["text"] for r in mix.collect()]), strict=True))
    last = {}
    got = packed.collect()
    assert sum(r["length"] for r in got) == sum(len(i) for i in ids_of([r["text"] for r in mix.collect()]))
    for r in got:
        last[(r["doc_id"], r["ids_crc32"])] = last.get((r["doc_id"], r["ids_crc32"]), 0) + 1
    assert all(last.get(k, 0) >= n for k, n in want.items())


@pytest.mark.parametrize("bucket", [4, 512])
def test_near_copies_go(spark, tmp_path, bucket, monkeypatch):
    """Copies with edited words, most of a similarity of 0.8 to 0.95, against all pairs."""
    monkeypatch.setattr(paragraphs, "BUCKET", bucket)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(100, 300))]
        rows.append(base)
        for _ in range(3):
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.randint(1, max(1, len(copy) // 45))):
                copy[i] = rng.choice(words)
            rows.append(copy)
    rng.shuffle(rows)
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in rows]
    top, pairs = list(range(len(rows))), 0

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if (share := len(a & sets[j]) / len(a | sets[j])) >= 0.8:
                pairs += share < 0.95
                x, y = sorted((find(i), find(j)))
                top[y] = x
    assert pairs > 60
    docs = spark.createDataFrame([(i, " ".join(t), "mine") for i, t in enumerate(rows)], "doc_id long, text string, no string").repartition(3)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in range(len(rows))}


def test_near_fingerprints_go(spark, tmp_path):
    """A copy whose fingerprint is within three bits goes, though its shingles are less alike; so does what is like that copy alone."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(900)]

    def edited(text, n):
        out = list(text)
        for i in rng.sample(range(len(out)), n):
            out[i] = rng.choice(words)
        return out

    def share(a, b):
        a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    def bits(a, b):
        return (brute_fingerprint(" ".join(a)) ^ brute_fingerprint(" ".join(b))).bit_count()

    base = [rng.choice(words) for _ in range(600)]
    copy = next(t for t in iter(lambda: edited(base, 16), None) if bits(base, t) <= 3 and share(base, t) < 0.8)
    far = next(t for t in iter(lambda: edited(copy, 8), None) if min(bits(base, t), bits(copy, t)) > 3 and share(copy, t) >= 0.85 and share(base, t) < 0.8)
    other = [rng.choice(words) for _ in range(600)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((base, copy, far, other, base))] + [(7, None), (8, "")], "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path)).collect()} == {0, 3, 7}


def test_no_documents(spark, folder, tmp_path):
    other = tmp_path / "none"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(other / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(other / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(other)).count() == 0


@pytest.mark.parametrize("name", ["op3_source_mix", "op7_top_k"])
def test_queries_match_sql(spark, name):
    state, note, _ = check.compare(spark, check.connect(SF), name, SF)
    assert state == "OK", note


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)])
def test_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / "empty" / f"{t}.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "empty" / "embeddings.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "empty" / "conversations.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    of_its_own = {"op12_chat": 1}       # the conversation that the query adds
    for name, query in entry.queries().items():
        if re.match(r"op\d+_|pipeline", name):
            assert query(spark, str(tmp_path / "empty")).count() == of_its_own.get(name, 0), name
