"""Classifiers and search by held-out accuracy and recall; edge rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.llm import ann, language_id, toxicity

D = "/root/testdata/sf0.01"


def test_toxicity(spark, clashing, nothing, edges):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    judged = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in judged if r["held"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == bool(r["predicted"]) for r in judged)
    out = toxicity.score(clashing, model)
    assert out.count() == clashing.count() and out.columns[-2:] == ["score", "predicted"] and dict(out.dtypes)["score"] == "double"
    assert toxicity.score(clashing, model, keep="clean").columns == clashing.columns
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(edges, spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(edges, none).collect()} <= {0, 1}
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert [r["score"] for r in toxicity.score(docs.limit(20).select("doc_id", "text"), again).collect()] == [r["score"] for r in toxicity.score(docs.limit(20).select("doc_id", "text"), model).collect()]


def test_words_are_hashed_alike_wherever_they_stand():
    def words(texts):
        raw = [t.encode() for t in texts]
        h, o = toxicity.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        return [h[a:b].tolist() for a, b in zip(o[:-1], o[1:], strict=True)]

    a, b = words(["Hello, wörld hello", ""]), words(["x", "", "", "y", "hello WÖRLD!", "wörld"])
    assert a[0][0] == a[0][2] == b[4][0] and a[0][1] == b[5][0] != b[4][1] and a[1] == b[1] == [] and len(b[0]) == len(b[3]) == 1


def test_language(spark, edges, clashing, nothing):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["held"]]) > 0.95
    out = {r["doc_id"]: r for r in language_id.predict(clashing, model).collect()}
    assert [out[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and out[4]["score"] == 0 and all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(edges, language_id.fit(nothing)).collect()} == {"und"}


def test_encoder_bundles_bound_letters():
    e = language_id.Encoder()
    raw = "ab b".encode()
    v = e.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    one = lambda c: np.random.Generator(np.random.PCG64(1_000_003 + c)).integers(0, 2, language_id.DIM, dtype=np.int8).astype(int) * 2 - 1
    edge, a, b = one(0), one(97), one(98)
    roll = np.roll
    assert (v == roll(edge, 2) * roll(a, 1) * b + roll(a, 2) * roll(b, 1) * edge + roll(edge, 2) * roll(b, 1) * edge).all()
    both = e.encode(np.frombuffer(raw + raw, np.uint8), np.array([0, 4, 4, 8]))
    assert (both[0] == v).all() and (both[2] == v).all() and not both[1].any()


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:400] = x[7]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0, None] * 8), (5005, [float("inf")] * 16), (None, [1.0] * 16), (5020, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("h", F.lit(1)).withColumn("rank", F.lit(1))
    vectors = ann.usable(df)
    assert vectors.count() == 3000
    got = {}
    for r in ann.search(vectors, vectors.where("vec_id % 50 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    hit = []
    for q in range(0, 3000, 50):
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(abs(s - exact[q, v]) < 1e-9 for _, v, s in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        want = np.lexsort((np.arange(3000), -exact[q]))[:20]
        hit.append(len({v for _, v, _ in own} & set(want.tolist())) / 20)
    assert np.mean(hit) >= 0.9
    few = ann.search(vectors.limit(3), vectors.limit(3), 20)
    assert few.count() == 6
    assert ann.search(vectors.limit(0), vectors.limit(0), 20).count() == 0


def test_ann_in_double_precision(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * 10.0 ** rng.integers(-3, 4, (400, 1))
    x[11] = [1e300, -1e300, 1e299, 3e300, 1.0, 0.0]
    x[12] = x[13] = [1e-300] * 6
    x[20] = np.nextafter(x[21], 9)  # alike in single precision
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert vectors.count() == 400
    got = {}
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = []
    for q in range(0, 400, 20):
        exact = np.array([math.fsum(x[q] * v) for v in x])
        want = [i for i in np.lexsort((np.arange(400), -exact)) if i != q][:20]
        assert all(math.isclose(s, exact[v], rel_tol=1e-9, abs_tol=1e-300) for _, v, s in got[q])
        hit.append(len({v for _, v, _ in got[q]} & set(want)) / 20)
    assert np.mean(hit) >= 0.9


def test_ann_query_against_all_pairs(spark):
    got = ann.query(spark, D).collect()
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    found, want = {}, {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert math.isclose(r["score"], score[np.searchsorted(ids, r["query_id"]), np.searchsorted(ids, r["vec_id"])], rel_tol=1e-9)
    for q in np.flatnonzero(ids % 20 == 0):
        want[ids[q]] = set(ids[np.lexsort((ids, -score[q]))[:20]].tolist())
    assert found.keys() == want.keys() and np.mean([len(found[q] & want[q]) / 20 for q in want]) >= 0.95


def test_language_query(spark):
    got = {r["doc_id"]: r for r in language_id.query(spark, D).collect()}
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if got[r["doc_id"]]["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held if r["lang"]]) > 0.95


def test_language_of_equal_and_tied_rows(spark):
    rows = [(i, "abc abc" if i % 2 else "xyz xyz", "b" if i % 2 else "a") for i in range(40)] + [(99, "abc abc", None), (99, "abc abc", None), (100, "123 ...", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df, language_id.fit(df)).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] >= 99} == {(99, "b"), (100, "und")} and len(got) == len(rows)
    same = spark.createDataFrame([(i, "abc", "b" if i % 2 else "a") for i in range(40)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.predict(same, language_id.fit(same)).collect()} == {"a"}  # of equal cosines the smaller name


def test_toxicity_query(spark):
    got = {r["doc_id"]: r for r in toxicity.query(spark, D).collect()}
    labels = spark.read.parquet(f"{D}/labels.parquet").collect()
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.9


@pytest.mark.parametrize("n", [1, 5, 50])
def test_top_takes_the_smaller_of_ties(n):
    score = np.array([[1, 3, 3, 2, 3, 0, 1], [0, 0, 0, 0, 0, 0, 0]], np.float32)
    at = ann._top(np.arange(7), score, n)
    want = [np.lexsort((np.arange(7), -s))[:n].tolist() for s in score]
    assert at.tolist() == want
