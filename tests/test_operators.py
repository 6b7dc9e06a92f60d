"""Operators on small tables: known results, edge texts and agreement of the two ways."""

import pytest
from pyspark.sql import functions as F

from strandex.functions import registry, scalars
from strandex.operators import check, distributed, index, intervals, matching, ranges, repeats, search, strings
from strandex.sources import texts as sources

EDGE = [b"", b"a", b"aaaa", b"banana", b"mississippi", b"a\x00a\x00", b"\xff\xfe\xff", b"x.*x.*", "é€é€".encode(), b"abaababa" * 9]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, bytearray(t)) for i, t in enumerate(EDGE)] + [(99, None)]
    return spark.createDataFrame(rows, "doc_id long, text binary")


def one(spark, *texts):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary")


def rows(df, *columns):
    return [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect()]


def test_index_of_banana(spark):
    for method in ("sql", "kernel", "auto"):
        i = index.build_index(one(spark, b"banana"), method)
        assert rows(i.orderBy("rank"), "pos", "lcp", "bwt") == [(5, 0, b"n"), (3, 1, b"n"), (1, 3, b"b"), (0, 0, b"\0"), (4, 0, b"a"), (2, 2, b"a")]
        packed = index.packed(i).first()
        assert (packed["sa"], packed["isa"], packed["lcp"]) == ([5, 3, 1, 0, 4, 2], [3, 2, 5, 1, 4, 0], [0, 1, 3, 0, 0, 2, 0])
        assert bytes(index.bwt(i).first()["bwt"]) == b"nnb\0aa"
        assert bytes(index.bwt(i, one(spark, b"banana")).first()["bwt"]) == b"annb\0aa"


def test_both_ways_agree_and_are_sound(table):
    a, b = (index.build_index(table, m) for m in ("sql", "kernel"))
    assert sorted(rows(a, "*")) == sorted(rows(b.select(a.columns), "*"))
    assert check.violations(a, table).count() == 0
    check.assert_sound(b, table)
    broken = b.withColumn("pos", F.when(F.col("rank") == 1, 0).otherwise(F.col("pos")))
    with pytest.raises(ValueError, match="not sound"):
        check.assert_sound(broken, table)
    assert {r["check"] for r in check.violations(b.where("doc_id <> 3"), table).collect()} == {"size"}


def test_distributed_suffix_array(table):
    got = distributed.suffix_array_distributed(table)
    assert sorted(rows(got, "doc_id", "rank", "pos")) == sorted(rows(index.build_index(table, "kernel"), "doc_id", "rank", "pos"))


def test_search(spark, table):
    t = one(spark, b"banana", b"aaaa", b"a", b"")
    assert [(r["doc_id"], r["pos"]) for r in search.find_sorted(t, "ana").orderBy("doc_id", "ord").collect()] == [(0, 3), (0, 1)]
    assert search.find(t, "a").groupBy("doc_id").count().orderBy("doc_id").collect() == [(0, 3), (1, 4), (2, 1)]
    assert search.find(t, "").count() == 11
    for q in ("", "a", "aa", "x.*", "\\E"):
        counts = {r["doc_id"]: r["n"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(["banana", "aaaa", "x.*x.*", "\\E\\E", ""])], "doc_id long, text string").select("doc_id", search.occ(F.col("text"), q).alias("n")).collect()}
        for i, x in enumerate(["banana", "aaaa", "x.*x.*", "\\E\\E", ""]):
            assert counts[i] == (sum(x.startswith(q, k) for k in range(len(x))) if q else len(x)), (q, x)
    i = index.build_index(table)
    for q in (b"", b"a", b"an", b"ss", b"\xff", b"\x00", b"zz"):
        got = {r["doc_id"]: sorted(x["pos"] for x in search.find_indexed(i, table, q).where(F.col("doc_id") == r["doc_id"]).collect()) for r in search.sa_interval(i, table, q).collect()}
        want = {k: [p for p in range(len(t)) if t.startswith(q, p)] for k, t in enumerate(EDGE)}
        assert got == {k: v for k, v in want.items() if v}
    many = search.find_many(table, spark.createDataFrame([(1, "a"), (2, "ss"), (3, ""), (4, None), (5, "a")], "query_id int, q string"))
    want = sorted((k, i, p) for k, t in enumerate(EDGE) for i, q in ((1, b"a"), (2, b"ss"), (3, b""), (5, b"a")) for p in range(len(t)) if t.startswith(q, p))
    assert sorted(rows(many, "doc_id", "query_id", "pos")) == want


def test_many_queries_by_join(table, spark, monkeypatch):
    asked = spark.createDataFrame([(1, "a"), (2, "ss"), (3, ""), (4, None), (5, "a"), (6, "abaababaabaababaab"), (7, "issi")], "query_id int, q string")
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    got = search.find_many(table, asked)
    want = sorted((k, r["query_id"], p) for k, t in enumerate(EDGE) for r in asked.collect() if r["q"] is not None for p in range(len(t)) if t.startswith(r["q"].encode(), p))
    assert sorted(rows(got, "doc_id", "query_id", "pos")) == want


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_first_of_many_queries(spark, limit, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
    held = [(1, b"banana ana"), (1, b"an apple, banana"), (None, b"banana"), (2, b"banana"), (2, b"banana"), (3, None), (4, b"")]
    asked = [(7, b"ana"), (7, b"ana"), (8, b"an"), (None, b"banana"), (9, b"zz"), (10, None), (11, b"a" * 20), *((20 + k, b"%03d" % k) for k in range(70)), (12, b"")]
    t = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in held], "doc_id long, text binary")
    q = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in asked], "query_id int, q binary")
    order = lambda r: tuple((x is None, x or 0) for x in r)
    for first in (True, False):
        want = [(i, k, p) for i, x in held if x for k, y in asked if y is not None for p in [p for p in range(len(x)) if x.startswith(y, p)][: 1 if first else None]]
        assert sorted(rows(search.find_many(t, q, first=first), "doc_id", "query_id", "pos"), key=order) == sorted(want, key=order)


def test_bisect(table):
    i, packed = index.build_index(table), index.packed_texts(table)
    for q in (b"", b"a", b"an", b"b", b"\xff", b"zz"):
        for start, stop in ((0, None), (1, 4), (3, 100), (50, 60)):
            want = []
            for k, t in enumerate(EDGE):
                heads = [t[p : p + len(q)] for p in sorted(range(len(t)), key=lambda p: t[p:])]
                inside, first = heads[start:stop], min(start, len(heads))
                if heads:
                    want.append((k, first + sum(h < q for h in inside), first + sum(h <= q for h in inside)))
            for got in (search.bisect(i, table, q, start, stop), search.bisect_packed(packed, q, start, stop)):
                assert sorted(rows(got, "doc_id", "lo", "hi")) == want


def test_get_children(table):
    i = index.build_index(table)
    t = EDGE[4]
    sa = sorted(range(len(t)), key=lambda p: t[p:])

    def by_hand(byte, left, right):
        shared = 0
        while len({t[p + shared : p + shared + 1] for p in sa[left : right + 1]}) == 1:
            shared += 1
        own = [r for r in range(left, right + 1) if t[sa[r] + shared : sa[r] + shared + 1] == byte]
        return [(own[0], own[-1])] if own else []

    for byte in (b"i", b"s", b"p", b"z"):
        assert rows(search.get_children(i, table, byte[0]).where("doc_id = 4"), "lb", "rb") == by_hand(byte, 0, len(t) - 1)
        assert rows(search.get_children(i, table, byte[0], 0, 3).where("doc_id = 4"), "lb", "rb") == by_hand(byte, 0, 3)
        assert rows(search.get_children(i, table, byte[0], 2, 2).where("doc_id = 4"), "lb", "rb") == []


def test_search_by_heads_prunes_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "heads")
    sources.write_heads(index.with_heads(index.build_index(table), table), path)
    stored = spark.read.parquet(path)
    for q in (b"ana", b"\xff", b"abaababaab", b"", b"zz"):
        assert sorted(rows(search.find_indexed(stored, table, q), "doc_id", "ord", "pos")) == sorted(rows(search.find_indexed(index.build_index(table), table, q), "doc_id", "ord", "pos"))
    plan = search.find_indexed(stored, table, b"ana")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(head" in plan and "LessThan(head" in plan and "Join" not in plan


def test_materialised(table):
    i = index.build_index(table)
    assert index.materialised(i) == []
    i.persist()
    assert index.materialised(i) == i.columns
    i.unpersist()


def test_index_columns(table):
    whole = index.index_kernel(table)
    for columns in (("pos",), ("rank", "pos"), ("lcp", "bwt")):
        assert sorted(rows(index.index_kernel(table, columns), "doc_id", *columns)) == sorted(rows(whole, "doc_id", *columns))


def test_order_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("text"))
    got = {r["doc_id"]: r["sa"] for r in index.index_kernel(docs, ("rank", "pos")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos"))), lambda x: x["pos"]).alias("sa")).collect()}
    for r in docs.collect():
        t = bytes(r["text"] or b"")
        if 0 < len(t) < 5000:
            assert got[r["doc_id"]] == sorted(range(len(t)), key=lambda p, t=t: t[p:])


def test_range_minimum_by_kernel(spark):
    a = [3, 1, 2, 1] * 150
    arrays = spark.createDataFrame([(1, a), (2, [5])], "doc_id long, values array<int>")
    asked = [(1, 0, 3), (1, 2, 2), (1, 0, 599), (1, 255, 257), (2, 0, 0)]
    got = ranges.rmq_kernel(arrays, spark.createDataFrame([*asked, asked[0]], "doc_id long, i int, j int"))
    assert sorted(rows(got, "doc_id", "i", "j", "argmin")) == sorted((k, i, j, min(range(i, j + 1), key=lambda x: (a[x], x)) if k == 1 else 0) for k, i, j in asked)
    for bad in ((1, 3, 2), (1, 0, 600), (3, 0, 0)):
        with pytest.raises(Exception, match="IndexError"):
            ranges.rmq_kernel(arrays, spark.createDataFrame([bad], "doc_id long, i int, j int")).collect()


def test_shared_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace as Some

    from strandex.plans import lineage

    for master in ("spark://x:7077", "local-cluster[3,2,1024]", "yarn"):
        session = Some(conf=Some(get=lambda k, d: None), sparkContext=Some(master=master))
        with pytest.raises(ValueError, match="checkpoint"):
            lineage.shared_dir(session)


def test_contains_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "banana"), (2, "x")], "doc_id long, text string").write.parquet(path)
    df = spark.read.parquet(path).where(search.contains(F.col("text"), "nan"))
    assert "StringContains(text,nan)" in df._jdf.queryExecution().toString() and df.count() == 1


def test_range_minimum(spark):
    values = spark.createDataFrame([(1, k, v) for k, v in enumerate([3, 1, 2, 1] * 150)], "doc_id long, k int, val int")
    asked = [(0, 3), (2, 2), (2, 3), (0, 599), (255, 257), (4, 511), (598, 599)]
    got = {(r["i"], r["j"]): r["argmin"] for r in ranges.rmq(values, spark.createDataFrame([(1, *q) for q in asked], "doc_id long, i int, j int")).collect()}
    a = [3, 1, 2, 1] * 150
    assert got == {(i, j): min(range(i, j + 1), key=lambda x: (a[x], x)) for i, j in asked}
    for bad in ((3, 2), (0, 600)):
        with pytest.raises(Exception, match="IndexError"):
            ranges.rmq(values, spark.createDataFrame([(1, *bad)], "doc_id long, i int, j int")).collect()


def test_tree(spark):
    nodes = intervals.tree(one(spark, b"banana"))
    assert rows(intervals.postorder(nodes).orderBy("ord"), "lcp", "lb", "rb") == [(3, 1, 2), (1, 0, 2), (2, 4, 5), (0, 0, 5)]
    assert rows(intervals.preorder(nodes).orderBy("ord"), "lb", "rb") == [(0, 5), (0, 2), (0, 0), (1, 2), (1, 1), (2, 2), (3, 3), (4, 5), (4, 4), (5, 5)]
    assert sorted(rows(intervals.children(index.build_index(one(spark, b"banana"))), "lcp", "lb", "rb")) == [(1, 0, 2), (2, 4, 5), (6, 3, 3)]
    assert rows(intervals.children(index.build_index(one(spark, b"a"))), "lcp") == []


def test_repeats(spark):
    t = one(spark, b"banana", b"not so Agamemnon, who spoke fiercely to ", b"abc", b"")
    got = sorted(rows(repeats.longest_repeated_substring(index.build_index(t), t), "doc_id", "pos", "substring"))
    assert got[:2] == [(0, 1, b"ana"), (0, 3, b"ana")]
    assert got[2:] == [(1, 0, b"no"), (1, 3, b" s"), (1, 5, b"o "), (1, 13, b"no"), (1, 20, b"o "), (1, 21, b" s"), (1, 38, b"o ")]
    t = one(spark, b"aaaa", b"mississippi", b"banana")
    assert sorted(rows(repeats.tandem_repeats(t), "doc_id", "left", "right", "period", "copies", "remainder")) == [(0, 0, 4, 1, 4, 0), (0, 0, 4, 2, 2, 0), (1, 1, 8, 3, 2, 1), (1, 2, 4, 1, 2, 0), (1, 5, 7, 1, 2, 0), (1, 8, 10, 1, 2, 0), (2, 1, 6, 2, 2, 1)]
    assert rows(repeats.primitive_tandem_repeats(t.where("doc_id = 0")), "left", "right", "period") == [(0, 4, 1)]
    assert sorted(rows(repeats.tandem_repeats_sql(t), "doc_id", "left", "right", "period", "unit")) == sorted(rows(repeats.tandem_repeats(t), "doc_id", "left", "right", "period", "unit"))


def test_matches(spark, monkeypatch):
    cases = [(b"ABABC", b"BABCA", b"BABC"), (b"AAAAA", b"AAAAAAA", b"AAAAA"), (b"Neque porro quisquam est qui dolorem ipsum quia dolor sit amet", b"Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris", b" quis"), (b"", b"a", b"")]
    pairs = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b, _) in enumerate(cases)], "pair_id long, text1 binary, text2 binary")
    assert rows(matching.longest_common_substring(pairs).orderBy("pair_id"), "result") == [(c,) for *_, c in cases]
    docs = one(spark, b"x" * 10 + b"the quick brown fox jumps over the lazy dog" + b"y" * 9, b"nothing to see here at all in this short text")
    items = one(spark, b"__the quick brown fox jumps over the lazy dog").withColumnRenamed("doc_id", "item_id")
    for limit in (1_000_000, 0):
        monkeypatch.setattr(matching, "MAX_SEEDS", limit)
        assert rows(matching.longest_shared_passage(docs, items), "doc_id", "item_id", "size") == [(0, 0, 43)]
        assert rows(matching.longest_shared_passage(docs, items.limit(0)), "size") == []


def test_whole_texts(spark):
    t = one(spark, b"mississippi", b"drabasafoolaloofasabard", b"abacdfgdcaba", b"aa", b"ba", b"")
    assert [r[0] for r in rows(strings.longest_palindrome(t).orderBy("doc_id"), "result")] == [b"ississi", b"drabasafoolaloofasabard", b"aba", b"aa", b"a", b""]
    assert rows(strings.lcs_with_reverse(t).where("doc_id = 2"), "result") == [(b"abacd",)]
    for f in (strings.minimum_rotation, strings.minimum_rotation_sql):
        assert [r[0] for r in rows(f(t).orderBy("doc_id"), "result")][3:] == [b"aa", b"ab", b""]
    goldens = {
        b"abaababa": [(0, 1, b"a"), (1, 1, b"b"), (0, 1, b"a"), (0, 3, b"aba"), (1, 2, b"ba")],
        b"1100101010000": [(0, 1, b"1"), (0, 1, b"1"), (2, 1, b"0"), (2, 1, b"0"), (1, 2, b"10"), (4, 4, b"1010"), (9, 3, b"000")],
        b"GTTGTTGTTGTT": [(0, 1, b"G"), (1, 1, b"T"), (1, 1, b"T"), (0, 9, b"GTTGTTGTT")],
        b"abbabbabbcabab": [(0, 1, b"a"), (1, 1, b"b"), (1, 1, b"b"), (0, 6, b"abbabb"), (9, 1, b"c"), (0, 2, b"ab"), (0, 2, b"ab")],
    }
    for text, want in goldens.items():
        assert rows(strings.lz_factors(one(spark, text)).orderBy("ord"), "pos", "len", "factor") == want


def test_sources(spark, tmp_path):
    t = one(spark, b"ab\xff")
    assert rows(sources.doubled(t), "text") == [(b"ab\xffab\xff",)] and rows(sources.reversed_bytes(t), "text") == [(b"\xffba",)]
    spark.createDataFrame([(1, "é"), (2, None)], "id int, s string").write.json(str(tmp_path / "j"))
    assert sorted(rows(sources.read_texts(spark, str(tmp_path / "j"), "id", "s", "json"), "doc_id", "text"), key=str)[0] == (1, "é".encode())
    i = index.build_index(one(spark, b"banana"))
    sources.write_index(i, "idx", 2)
    assert sorted(rows(sources.read_index(spark, "idx").select(i.columns), "*")) == sorted(rows(i, "*"))
    spark.sql("DROP TABLE idx")


def test_scalars_and_sql_names(spark):
    n = [0, 1, 2, 3, 12, 255, 256, 1 << 30]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    got = df.select(*(f(F.col("n")) for f in (scalars.log2i, scalars.lsb, scalars.popcount, scalars.parity, scalars.ctz, scalars.clz, scalars.ffs))).collect()
    for x, r in zip(n, got, strict=True):
        low = (x & -x).bit_length() - 1
        assert tuple(r) == (max(x.bit_length() - 1, 0), max(low, 0), x.bit_count(), x.bit_count() % 2, low if x else 32, 32 - x.bit_length(), low + 1)
    catalan = [r[0] for r in spark.range(1, 12).select(scalars.catalan(F.col("id").cast("int"))).collect()]
    assert catalan == [1, 1, 2, 5, 14, 42, 132, 429, 1430, 4862, 16796]
    assert [r["value"] for r in scalars.catalan_triangle(spark, 6).where("p = q").orderBy("p").collect()] == catalan[:6]
    assert registry.register_all(spark)
    r = spark.sql("SELECT text_suffix_array('banana') sa, text_occ('aaaa', 'aa') n, text_min_rotation('ba') r, text_longest_palindrome('abcba') p, text_lz_factors('aaaa') z, text_find(CAST(NULL AS STRING), 'a') e").first()
    assert r["sa"] == [5, 3, 1, 0, 4, 2] and r["n"] == 3 and bytes(r["r"]) == b"ab" and bytes(r["p"]) == b"abcba" and r["e"] is None
    assert [tuple(x) for x in r["z"]] == [(0, 1), (0, 3)]


def test_streams(spark, tmp_path):
    from strandex.streaming import texts as streaming

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "banana"), (2, "aa")], "doc_id long, text string").write.parquet(source)
    stream = streaming.stream_index(streaming.read_stream(spark, source, "doc_id long, text string", "doc_id", "text"))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination(60)
    assert spark.read.parquet(out).count() == 8


@pytest.mark.parametrize(("name", "args", "want"), [("stream_find", ("a",), 5), ("stream_tandem_repeats", (), 2), ("stream_lz_factors", (), 6), ("stream_rotations", (), 2), ("stream_palindromes", (), 2), ("stream_occ", ("a",), 2)])
def test_streamed_operators(spark, tmp_path, name, args, want):
    from strandex.streaming import texts as streaming

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "banana"), (2, "aa")], "doc_id long, text string").write.parquet(source)
    stream = getattr(streaming, name)(streaming.read_stream(spark, source, "doc_id long, text string", "doc_id", "text"), *args)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination(60)
    assert spark.read.parquet(out).count() == want
