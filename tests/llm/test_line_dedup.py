"""The edit join against plain dynamic programming."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import empty_documents, hard_documents, hard_rows, rows_of, with_clashes
from tidegate.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        p, how = rng.randrange(len(s)), rng.randrange(3)
        if how == 0:
            s.insert(p, rng.choice("abcdé"))
        elif how == 1 and len(s) > 1:
            del s[p]
        else:
            s[p] = rng.choice("abcdé")
    return "".join(s)


def sample_lines():
    rng = random.Random(1)
    lines = []
    for _ in range(60):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randrange(19, 50)))
        lines += [base, *(edited(rng, base, rng.randrange(0, 4)) for _ in range(4))]
    return lines + ["y" * 40 + "".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(40)]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        b = edited(rng, a, rng.randrange(0, 5))
        for most in range(4):
            assert line_dedup.edit_distance(a, b, most) == min(distance(a, b), most + 1)
    assert line_dedup.edit_distance("", "", 0) == 0 and line_dedup.edit_distance("", "ab", 2) == 2


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_no_pair_is_lost(edits):
    lines = sorted({x for x in sample_lines() if len(x) >= line_dedup.MIN_CHARS})
    want = {(j, i) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= edits and distance(lines[i], lines[j]) <= edits}
    found = set()
    for a, b in line_dedup.candidate_pairs(*line_dedup.line_keys(lines, np.arange(len(lines)), edits), edits):
        found |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    assert len(want) > 50 and want <= found


def brute(rows):
    first, count = {}, Counter()
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\x0b\x0c\r"):
                count[line] += 1
                if line not in first or first[line] is None or (doc is not None and doc < first[line]):
                    first[line] = doc
    lines = sorted(first)
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = {}
    for x in lines:
        key = (first[x] is None, first[x], sha(x)) if first[x] is not None else (True, None, sha(x))
        r = root(x)
        best[r] = min(best.get(r, key), key, key=lambda k: (k[0], k[1] or 0, k[2]))
    return [(first[x], sha(x), len(x), count[x], links[x], best[root(x)][1], best[root(x)][2], best[root(x)][2] == sha(x)) for x in lines]


def test_line_classes(spark):
    rows = [(r[0], r[1]) for r in hard_rows() if r[0] != 107]
    lines = sample_lines()
    rows += [(200 + k // 5, "\n".join(lines[k : k + 5])) for k in range(0, len(lines), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.line_classes(with_clashes(df))
    assert rows_of(got) == sorted(brute(rows), key=repr)
    assert line_dedup.line_classes(empty_documents(spark)).count() == 0
    assert line_dedup.line_classes(hard_documents(spark)).count() > 50


def test_drop_lines(spark):
    rows = [(1, "the first long line of this text\nshort"), (2, "The first long line of this text\nanother line that is kept here"), (3, None)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(out) == [(1, "the first long line of this text\nshort"), (2, "another line that is kept here"), (3, "")]


def test_every_line_of_every_document_has_its_class(spark, tmp_path):
    from tidegate.llm.queries import op1_line_dedup

    boiler, near = "a boilerplate line in many documents", "A boilerplate line in many documents"
    rows = [(k, f"{boiler}\n \nonly in document {k * 1111}{k * 7777}") for k in (5, 3, 4)] + [(6, f"{near}\n{near}"), (None, boiler), (7, None), (3, f"{boiler}\n{boiler}")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op1_line_dedup(spark, str(tmp_path)).collect()
    facts = {r[1]: r[2:] for r in brute(rows)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(d, k, sha(x), *facts[sha(x)][:-1]) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(want, key=repr)
    kept = sorted((r["doc_id"], r["line_no"], r["line_sha256"]) for r in got if r["kept"])
    assert kept == sorted([(3, 0, sha(boiler)), *((k, 2, sha(f"only in document {k * 1111}{k * 7777}")) for k in (3, 4, 5))])


def test_drop_lines_keeps_one_of_equal_lines(spark):
    line = "a boilerplate line in many documents"
    rows = [(2, f"{line}\nsecond own line"), (1, f"first\n{line}\n\n{line}"), (3, line), (None, line)]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert rows_of(out) == sorted([(2, "second own line"), (1, f"first\n{line}\n"), (3, ""), (None, "")], key=repr)
