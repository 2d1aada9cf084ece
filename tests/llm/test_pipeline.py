"""The corpus pipeline on a small corpus with planted cases, and against its steps done in plain Python."""

import re
from collections import defaultdict
from itertools import combinations

import corpus_pipeline as pipeline
import pytest

from tests.llm.test_llm import BASE, EDITED, LINES, ROWS, align, frame, labelled, tokens, words
from tidemark.llm import bpe, quality, simhash


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables: labelled documents, near copies, repeated lines, a leaked item, and odd rows."""
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labs = labelled(240)
    item = words(40, 77)
    planted = [(1001, BASE), (1002, EDITED), (1003, words(60, 70) + " " + item + " " + words(60, 71)), (1004, LINES + "\n" + words(30, 72)), (1005, words(30, 73) + "\n" + LINES), (1006, None), (None, "no id"), (1007, "")]
    frame(spark, rows + planted).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labs[:200], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, labs


def test_stages(spark, sf):
    at, labs = sf
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, at).checkpoint()
        assert docs.columns == before.columns, name
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    bad = {i for i, q, t in labs if q == 0 or t == 1}
    kept = seen["quality"]
    assert len(bad - set(kept)) >= 0.95 * len(bad)
    assert {i for i, _, _ in labs} - bad <= set(kept)
    assert {1001, 1002, 1003, 1004, 1005, 1006, None, 1007} <= set(kept)
    assert seen["lines"][1005] == words(30, 73) and seen["lines"][1004] == kept[1004]
    assert set(kept) - set(seen["near_duplicates"]) == {1002}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {1003}
    out = pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert len(out) == docs.count() and all(r.round_trip in (True, None) for r in out)


def test_run_gives_what_the_stages_give(spark, sf):
    at, _ = sf
    out = pipeline.run(spark, at)
    assert out.columns == ["doc_id", "tokens", "n_tokens", "round_trip"]
    ids = [r.doc_id for r in out.collect()]
    assert 1002 not in ids and 1003 not in ids and {1001, 1004, 1005, 1006, 1007, None} <= set(ids)


def test_run_reads_the_parquet_of_the_stage_before(spark, sf, monkeypatch):
    at, _ = sf
    read = {}

    def watch(name, stage):
        def run(spark, docs, sf_dir):
            read[name] = docs.inputFiles()
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(pipeline, "STAGES", [(n, watch(n, f)) for n, f in pipeline.STAGES])
    pipeline.run(spark, at)
    names = [n for n, _ in pipeline.STAGES]
    for before, name in zip(names, names[1:]):
        assert read[name] and all(f"/{before}.parquet/" in x for x in read[name])


def test_empty_and_odd_documents(spark, sf):
    at, _ = sf
    for name, stage in pipeline.STAGES:
        assert stage(spark, frame(spark, []), at).count() == 0, name
        odd = frame(spark, [r for r in ROWS if r[1] is None or not r[1].strip() or r[0] is None])
        assert stage(spark, odd, at).count() == odd.count(), name


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "tokens"]
    assert pipeline.ORACLE_SQL is None


def without_windows(rows):
    """Line dedup in plain Python, on rows with distinct ids; documents that lose all their lines go."""
    seen, out = set(), []
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(re.search(r"[^\t\r ]", x) for x in w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        if len(gone) < len(lines):
            out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def one_of_each(spark, rows):
    """Near dedup by all pairs of signatures; equal signatures and sizes are duplicates too."""
    sig = {x.doc_id: (x.size, x.s1, x.s2) for x in simhash.signatures(frame(spark, rows)).collect()}
    root = {i: i for i in sig}

    def find(x):
        return x if root[x] == x else find(root[x])

    bits = lambda x: bin(x & (2**64 - 1)).count("1")
    for a, b in combinations(sorted(sig), 2):
        (n, x, y), (m, u, v) = sig[a], sig[b]
        if bits(x ^ u) <= simhash.DISTANCE and bits(x ^ u) + bits(y ^ v) <= simhash.CHECK and max(n, m) <= simhash.RATIO * min(n, m):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [(i, t) for i, t in rows if i not in root or find(i) == i]


def test_run_against_plain_python(spark, tmp_path):
    """Every stage by brute force, on what the one before it left: the rows of run(), token by token."""
    import tiktoken

    rows, labs = labelled(160)
    item, other = words(40, 77), words(25, 78)
    edited = " ".join("edit" if k % 7 == 3 else w for k, w in enumerate(item.split()))
    many = [(2000 + i, f"{words(12, 8000 + i)}\n{LINES}\n{words(12, 8100 + i)}") for i in range(6)]
    near = [(3000 + 10 * g + k, " ".join(w if j != 17 * k + 3 else "other" for j, w in enumerate(words(90, 8200 + g).split()))) for g in range(6) for k in range(3)]
    planted = [(1001, words(60, 70) + " " + item + " " + words(60, 71)), (1002, edited), (1003, other), (1004, LINES), (1005, LINES), (1006, words(200, 72) + " ünï 漢字"), (1007, BASE), (1008, BASE), (1009, EDITED)]
    rows += many + near + planted
    at = str(tmp_path)
    frame(spark, rows).repartition(5).write.parquet(f"{at}/documents.parquet")
    lab = spark.createDataFrame(labs[:120], "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{at}/labels.parquet")
    bench = [(0, item), (1, other), (2, "a b")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = {r.doc_id: r.tokens for r in pipeline.run(spark, at).collect()}

    docs = frame(spark, rows)
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, lab)).collect() if r.keep}
    left = without_windows([x for x in rows if x[0] in good])
    left = one_of_each(spark, left)
    held = defaultdict(list)
    for i, t in left:
        for j, x in bench:
            if len(tokens(x)) >= 3 and align(tokens(x), tokens(t)) / (2 * len(tokens(x))) >= 0.5:
                held[i].append(j)
    left = [(i, t) for i, t in left if i not in held]
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})
    assert got == {i: enc.encode_ordinary(t) for i, t in left}
    assert set(held) == {1001, 1002, 1003} and 1005 not in got and 1004 in got and 1008 not in got and 1009 not in got and 3000 in got and 3001 not in got
