"""Queries of the training-data operators and the pipeline at small scale."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strandex.llm import mixing, queries, simhash, toxicity

from .test_documents import lowered

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        p = f"{D}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, con, name):
    df = queries.QUERIES[name](spark, D)
    c = con.execute(queries.ORACLE_SQL[name])
    names, want = [d[0] for d in c.description], c.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want)


def near_copies_gone(rows):
    """(doc_id, text) that stay: the smallest doc_id of each class of texts linked by a Jaccard similarity of 0.8."""
    sets = [set(five_words(t)) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for i, (d, t) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (d, t)), (d, t))
    return sorted(least.values())


def five_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [()]


def with_items_windows(rows, items, window=10):
    """doc_ids of texts in which ten words in a row (or all of a shorter item) of an item occur."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    known = {tuple(w[i : i + window]) for w in (words(t) for t in items) if w for i in range(max(1, len(w) - window + 1))}
    sizes = {len(x) for x in known}
    return {d for d, t in rows for w in [words(t)] if any(tuple(w[i : i + n]) in known for n in sizes for i in range(len(w) - n + 1))}


def passages_cut(rows, width=100):
    """Texts without the bytes of strings that start earlier, and without characters cut by that."""
    seen, out = {}, []
    for i, t in sorted(rows):
        b = t.encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if seen.setdefault(b[p : p + width], (i, p)) != (i, p):
                gone[p : p + width] = [True] * width
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, "".join(kept)))
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, D), "test")
        after = kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == names
            assert all(r["n_chars"] == len(r["text"]) for r in after)
            got = sorted((r["doc_id"], r["text"]) for r in after)
        if name == "simhash_near_dedup":
            assert got == near_copies_gone(sorted(before.items()))
        if name == "suffix_array_dedup":
            assert got == passages_cut(before.items())
        if name == "decontamination":
            hit = with_items_windows(before.items(), [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()])
            assert hit and got == sorted((i, t) for i, t in before.items() if i not in hit)
    first = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    judged = toxicity.score(first.select("doc_id", "text"), toxicity.fit(first, labels)).collect()
    stay = {r["doc_id"] for r in kept["toxicity"]}
    assert stay == {r["doc_id"] for r in judged if not r["predicted"]}
    known = labels.collect()
    assert np.mean([r["doc_id"] in stay for r in known if r["toxic"] == 0]) > 0.98 and np.mean([r["doc_id"] in stay for r in known if r["toxic"] == 1]) < 0.5
    mixed = kept["mixing"]
    words, target, most = Counter(), {}, Counter()
    for r in mixed:
        words[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert 1 <= r["copy"] <= r["copies"] <= 3
    assert all(abs(words[s] - target[s]) <= most[s] for s in target)


def test_stages_take_edge_rows(spark, edges, nothing, clashing, tmp_path):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").withColumn("quality", simhash.F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = edges.withColumn("text", simhash.F.lit(None).cast("string"))
    for docs in (clashing.union(clashing), nothing, empty):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "mixing":
                own = [*mixing.RESULT, "copy"]
                assert sorted(out.columns) == sorted({*docs.columns, *own} - {"taken"}) and len(set(out.columns)) == len(out.columns)
            else:
                assert out.columns == docs.columns
            assert out.count() <= 3 * n


def test_driver_memory_is_given_back(spark, monkeypatch):
    """The JVM can be told to give freed native memory back; every stage begins with that, every cut of a lineage ends with it."""
    from strandex.llm import common

    assert common.trim_jvm(spark)
    calls = []
    monkeypatch.setattr(corpus_pipeline, "release", calls.append)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(AttributeError):
            stage(None, None, "")
    assert calls == [None] * len(corpus_pipeline.STAGES)
    monkeypatch.setattr(common, "trim_jvm", calls.append)
    assert common.checkpoint(spark.range(3)).count() == common.stored(spark.range(3), "three").count() == 3
    assert calls[len(corpus_pipeline.STAGES):] == [spark, spark]
