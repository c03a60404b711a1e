"""The near-dedup stage against plain sets of five words."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from tests.llm.fixtures import SCHEMA, empty_documents, hard_rows, with_clashes
from tests.llm.test_operators import WORD, lower
from tidegate.llm import near_dedup


def brute_set(text):
    tokens = WORD.findall(lower(text or ""))
    return {" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def brute_roots(texts):
    """A number for each text, the same for texts that are linked directly or through others."""
    sets = [brute_set(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or Fraction(len(a & b), len(a | b)) >= Fraction(4, 5):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def brute_kept_rows(rows):
    root = brute_roots([t for _, t, *_ in rows])
    best = {}
    for (i, *_), r in zip(rows, root):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    return sorted((None if late else i for late, i in best.values()), key=repr)


def near_copies():
    """Copies with a few words changed: far more than three bits apart, some just above and some just below 0.8."""
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 50, 90, 200]))]
        for _ in range(6):
            words = list(base)
            for p in rng.sample(range(len(words)), rng.randrange(max(len(words) // 25, 2) + 1)):
                words[p] = f"w{rng.randrange(4000)}"
            rows.append((1000 + len(rows), " ".join(words)))
    return [(i, t, "en", "s", len(t)) for i, t in rows]


@pytest.mark.parametrize("crowded", [64, 2])
def test_near_copies_go(spark, tmp_path, monkeypatch, crowded):
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    rows = [*hard_rows(), *near_copies()]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    want = brute_kept_rows(rows)
    assert len(want) < len(rows) - 20
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want
    assert stage(spark, with_clashes(empty_documents(spark)), str(tmp_path)).count() == 0


def test_signatures_drop_no_link():
    rng = np.random.default_rng(3)
    kept = dropped = 0
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0.02, 0.1, 0.2, 0.6])], rng.integers(0, 1 << 63, int(n * rng.choice([0, 0.05, 0.2])), dtype=np.uint64)]))
        columns = [pa.array([1]), pa.array([2]), pa.array([len(a)], pa.int32()), pa.array([len(b)], pa.int32()), *(pa.array([near_dedup.signature(x)], pa.binary()) for x in (a, b))]
        (out,) = near_dedup._close_rows(iter([pa.RecordBatch.from_arrays(columns, names=["a", "b", "na", "nb", "sa", "sb"])]))
        assert out.num_rows or not near_dedup.linked(a, b)
        kept, dropped = kept + out.num_rows, dropped + (not out.num_rows)
    assert kept > 50 and dropped > 50


def test_a_crowded_run_gives_a_forest_not_all_pairs():
    base = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.array([np.frombuffer(near_dedup.signature(np.append(base[k % 5 :], np.uint64(k))), np.uint64) for k in range(300)])
    n = np.array([201 - k % 5 for k in range(300)])
    count = lambda every: sum(len(a) for a, _ in near_dedup._forest(n, sign, np.arange(300), near_dedup.PIVOTS, every))
    assert count(False) == 299 and count(True) == 300 * 299 // 2
