"""The pipeline against the brute-force versions of its stages."""

import math
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
import public_tokenizers
from tests.llm.fixtures import SCHEMA, hard_rows, with_clashes
from tests.llm.test_near_dedup import brute_roots
from tests.llm.test_operators import SECRETS, brute_base_spans, brute_kept, lower


def rows():
    filler = " ".join(f"word{i}" for i in range(40))
    hidden = [SECRETS[0][1], 'passwd:"hunter2hunter2" end']
    more = [(300 + k, f"{filler} tail{k // 2} {hidden[k % 2]}") for k in range(6)]
    more += [(400 + k, " ".join(f"w{(i * 7 + k) % 90}" for i in range(80))) for k in range(3)] + [(410, " ".join(f"w{(i * 7) % 90}" for i in range(80)).upper())]
    return [*hard_rows(), *((i, t, "en", "s", len(t)) for i, t in more)]


def expected(docs):
    kept = [(i, t or "") for i, t, *_ in docs if brute_kept(t)]
    best = {}
    for i, t in kept:
        k = lower(t)
        best[k] = (i, t) if k not in best or best[k][0] is None or (i is not None and i > best[k][0]) else best[k]
    kept = list(best.values())
    roots = brute_roots([t for _, t in kept])
    first = {}
    for (i, t), r in zip(kept, roots):
        first[r] = (i, t) if r not in first or (i is not None and (first[r][0] is None or i < first[r][0])) else first[r]
    out = []
    for i, t in first.values():
        end, parts = 0, []
        for s, _, e in brute_base_spans(t):  # no weak part in these texts
            if s >= end:
                parts += [t[end:s], "[REDACTED]"]
            end = max(end, e)
        out.append((i, "".join(parts) + t[end:]))
    return out


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = rows()
    with_clashes(spark.createDataFrame(docs, SCHEMA)).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in expected(docs):
        ids = [*model.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.append((i, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(sum(w[3] for w in want) / 4096) + 1


def test_stages_keep_the_columns(spark, tmp_path):
    docs = with_clashes(spark.createDataFrame(rows(), SCHEMA))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
