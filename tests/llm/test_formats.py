"""HTML, chat and WARC: by hand and by round trip."""

import base64
import hashlib
import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql.functions import lit

from strandex.llm import chat, html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><main id=content><article class="post post-17"><h1>Head &amp;
 line</h1><p>First <b>bold<br>part &eacute; &#x41;<p>Second   one</p><!-- no --><aside>Side</aside><form><input>Send</form><script>var a="</p>";</script>
<section class=comments><p>A comment</p></section></article></main><div class="sidebar"><p>More</p></div><footer>&copy; me</footer></body></html>"""


def test_extract_by_hand():
    assert html_text.text_of(PAGE) == "Head & line First bold part é A Second one"
    page = html_text.parse(PAGE)
    number, path = html_text.best(page, html_text.lines(page))[0], []
    while number:
        path.append(page.step[number])
        number = page.parent[number]
    assert path[::-1] == ["html", "body", "main.content", "article.post.post-#"]
    assert html_text.text_of("plain  text &amp more &am") == "plain text & more &am"
    for odd in (None, "", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<a href='>'>x", "<" * 2000, "<div>" * 3000, "</>", "</3>", "<a b=>x", "<svg><p>x"):
        html_text.text_of(odd)


@pytest.mark.parametrize("open_", ["article class='post tag-politics'", "main class='has-sidebar'", "main class=no-sidebar", "div class='post tag-legal category-legal'", "div class=search", "form action=x", "article class=comments"])
def test_containers_of_the_text_are_no_chrome(open_):
    tag = open_.split()[0]
    page = f"<body><nav>Menu</nav><div class='sidebar-widget'>More</div><div class=site-header>Site</div><{open_}><input type=hidden><div class='entry-header'><h1>Title</h1></div><p>{'word ' * 60}</p><div class=post-tags>t</div><form>Your name <input></form></{tag}><div class=main-footer>me</div></body>"
    assert html_text.text_of(page) == "Title " + ("word " * 60).strip()


LONG = ("word " * 60).strip()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article class='post-17 post category-x tag-news'><p>{LONG}</article>", LONG),
        (f"<div class='layout has-sidebar'><p>{LONG}</div>", LONG),
        (f"<article class='post comment-enabled'><p>{LONG}</article>", LONG),
        (f"<article><p>In<section id=search-algorithms><p>{LONG}</section><section id=legal-history><p>Law</section></article>", f"In {LONG} Law"),
        ("<p>Hello <button>Click me</button> world <span class=share>Share</span></p>", "Hello world"),
        (f"<p>{LONG} <span class='ad'>Buy now</span> end</p>", f"{LONG} end"),
        ("<p title=don't>Text of it</p><p>more", "Text of it more"),
        (f"<div><div><p>{LONG}</p></div><ul class=menu><li><a href=x>a</a></ul></div>", LONG),
        (f"<table><tr><td><a href=x>Menu</a><td><p>{LONG}<p>{LONG}</table>", f"{LONG} {LONG}"),
        (f"<main><h1>T</h1><p>{LONG}</p><aside>no</aside><div role=navigation class=nav>no</div></main>", f"T {LONG}"),
        (f"<body><header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{LONG}</article>", f"T {LONG}"),
        (f"<form><p>{LONG}</p><input type=hidden></form>", LONG),
        (f"<article><p>{LONG}</p><form><label>Name</label><input><textarea>x</textarea></form></article>", LONG),
        (f"<article><p>{LONG}<pre>a  b\n c</pre><blockquote>q</blockquote><ul><li>1<li>2</ul></article>", f"{LONG} a b c q 1 2"),
        (f"<article><p data-class='ad' title=\"class=ad\">{LONG}</article>", LONG),
        (f"<article><p>{LONG}<style>p{{}}</style><script>'</p>'</script><noscript>n</noscript><svg><text>s</text></svg></article>", LONG),
        (f"<article><p>{LONG}</article><section class=comments><p>{LONG}</section><footer>f</footer>", LONG),
        (f"<article><p>a&nbsp;&lt;b&gt; &#8212; {LONG}</article>", f"a <b> — {LONG}"),
        (f"<div id=content><p>{LONG}</div><div class='newsletter-signup'>Join</div><div class=related>R</div>", LONG),
        (f"<article><p>{LONG}<br>x<hr>y<figure><img><figcaption>c</figcaption></figure></article>", f"{LONG} x y c"),
        (f"<ARTICLE><P>{LONG}</P><DIV CLASS='Cookie-Notice'>c</DIV></ARTICLE>", LONG),
        (f"<article><p>{LONG} <i>a<b>b</i>c</b> <a href='x>y'>l</a></article>", f"{LONG} abc l"),
    ],
)
def test_layouts(html, want):
    assert html_text.text_of(f"<html><head><title>t</title></head><body>{html}</body></html>") == want


@pytest.mark.parametrize("part", ["<div>x", "<a '", "<p><b><i>x</u>", "< ", "<svg>", "<!--", '<a b="', "<div class='x nav-y'>z", "<ul><li>x", "<form>x", "<div><p></i></p>"])
def test_time_is_linear_in_size_and_depth(part):
    def seconds(n):
        page = part * (n // len(part))
        began = time.process_time()
        html_text.text_of(page, "no such path")
        return time.process_time() - began

    assert seconds(400_000) < 8 * seconds(100_000) + 0.5


def test_consensus_against_all_votes_counted(spark):
    shapes = ["<main><p>{a}</p></main><div class=b{i}><p>{b}</p></div>", "<div class=x{i}><div class=y><p>{a}</p></div><p>{b}</p></div>", "<article><p>{a}<p>{b}</article>"]
    pages = []
    for i in range(60):
        a, b = " ".join([f"w{i}"] * (5 + i * 7 % 40)), " ".join([f"v{i}"] * (5 + i * 11 % 40))
        pages.append((i, f"https://h{i % 4}.example/{i}", "<body>" + shapes[i * i % 3].format(i=i, a=a, b=b)))
    pages.append(pages[0])
    votes = {}
    for _, url, html in pages:
        path, weight = html_text.vote_of(html)
        counted = votes.setdefault(url[8:18], Counter())
        counted[path] += weight
    top = {h: min(c, key=lambda p: (-c[p], p)) for h, c in votes.items()}
    want = sorted((i, url, html_text.text_of(html, top[url[8:18]])) for i, url, html in pages)
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, path string")
    assert sorted((r["page_id"], r["url"], r["text"]) for r in html_text.extract(df).collect()) == want


def test_consensus(spark):
    pages = [(i, "http://Host.example/x", f"<body><div class='main{i}'><p>{'word ' * 40}{i}</p></div><div class=extra><p>{'e ' * (300 if i == 3 else 5)}</p></div></body>") for i in range(4)]
    pages += [(9, None, None), (10, "http://host.example:80/", ""), (11, "u", "<p>x"), (None, "http://host.example/", "<p>no container")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert all(got[i]["text"] == ("word " * 40 + str(i)) for i in range(4))  # page 3 alone would take the other container
    assert got[9]["text"] == got[10]["text"] == "" and got[11]["text"] == "x" and got[None]["text"] == "no container" and got[11]["n_chars"] == 1
    assert html_text.extract(df.limit(0)).count() == 0


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    schemas = {"sum": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "tool", '{"tool_call_id": "c1", "content": "early"}'),
        (1, 2, "assistant", call({"id": "c1", "name": "sum", "arguments": '{"b": 1, "a": -2}'}, {"id": "c2", "name": "sum", "arguments": '{ "a" : 3 }', "depends_on": ["c1"]})),
        (1, 3, "tool", '{"tool_call_id": "c2", "content": "5"}'), (1, 4, "tool", '{"tool_call_id": "zz", "content": "lost"}'),
        (2, 0, "assistant", call({"id": "x", "name": "t", "arguments": "no json", "depends_on": ["y"]}, {"id": "y", "name": "t", "arguments": "{}", "depends_on": ["x"]}, {"id": "y", "name": "t", "arguments": "{}"})),
        (3, None, None, None), (None, 1, "user", "{not json"), (4, 1, "user", "same"), (4, 1, "user", "same"),
    ]
    df = turns(spark, rows)
    calls = {(r["conv_id"], r["call_id"], r["duplicate"]): r for r in chat.link(chat.parse(df), schemas).collect()}
    first, second = calls[1, "c1", False], calls[1, "c2", False]
    assert first["arguments"] == '{"a":-2,"b":1}' and first["errors"] == ["$.a: under minimum", "$.b: unknown"] and first["result_turn"] == 1 and first["level"] == 0
    assert second["errors"] == [] and second["level"] == 1 and calls[2, "x", False]["level"] is None and calls[2, "x", False]["errors"] == ["$: no JSON"] and (2, "y", True) in calls
    got = {}
    for r in chat.format_messages(df, schemas).collect():
        got.setdefault(r["conv_id"], {})[r["position"]] = r
    assert [got[1][k]["role"] for k in range(5)] == ["user", "assistant", "tool", "tool", "tool"]
    assert got[1][0]["message"] == '{"content":"say \\"hi\\"\\n","role":"user"}' and got[1][2]["message"] == '{"content":"early","role":"tool","tool_call_id":"c1"}'
    assert got[1][4]["linked"] is False and got[1][2]["linked"] and got[1][1]["n_errors"] == 2 and json.loads(got[1][1]["message"])["tool_calls"][0]["id"] == "c1"
    assert got[3][0]["message"] == "{}" and got[None][0]["message"] == '{"content":"{not json","role":"user"}' and len(got[4]) == 2
    assert chat.format_messages(df.limit(0)).count() == 0


def test_chat_keeps_text_beside_calls_and_null_keys(spark):
    text = json.dumps({"content": "Let me look", "note": {"b": 1, "a": None}, "tool_calls": [{"id": "c", "name": "t", "arguments": "{}"}, {"name": "t", "arguments": "{}"}, {"name": "t", "arguments": "{}"}]})
    result = '{"tool_call_id": "c", "content": "x"}'
    rows = [(1, 0, "assistant", text), (1, None, "assistant", text.replace('"c"', '"d"')), (None, 0, "assistant", text), (None, 1, "tool", result), (2, 0, "assistant", text), (2, 0, "assistant", "plain")]
    got = chat.format_messages(turns(spark, rows)).collect()
    made = [r for r in got if r["n_calls"]]
    assert len(got) == len(rows) and len(made) == 4 and all(r["n_calls"] == 3 for r in made)
    for r in made:
        m = json.loads(r["message"])
        assert m["content"] == "Let me look" and m["note"] == {"b": 1, "a": None} and len(m["tool_calls"]) == 3 and list(m) == sorted(m)
    assert [r["linked"] for r in got if r["role"] == "tool"] == [True]


def test_chat_levels_deep_chains(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROUNDS", 2)
    chain = [{"id": f"k{i}", "name": "t", "arguments": "{}", "depends_on": [f"k{i - 1}", "k0"] if i else []} for i in range(1200)]
    chain += [{"id": "x", "name": "t", "arguments": "{}", "depends_on": ["y", "k9"]}, {"id": "y", "name": "t", "arguments": "{}", "depends_on": ["x"]}]
    got = chat.link(chat.parse(turns(spark, [(None, 0, "assistant", json.dumps({"tool_calls": chain}))]))).collect()
    assert {r["call_id"]: r["level"] for r in got} == {**{f"k{i}": i for i in range(1200)}, "x": None, "y": None}


def test_chat_levels_of_large_conversations_go_on_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROUNDS", 2)
    monkeypatch.setattr(chat, "FOLLOWED", 4)
    long = [{"id": f"k{i}", "name": "t", "arguments": "{}", "depends_on": [f"k{i - 1}"] if i else []} for i in range(9)]
    short = long[:6]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": long})), (2, 0, "assistant", json.dumps({"tool_calls": short}))]
    got = chat.link(chat.parse(turns(spark, rows))).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got} == {**{(1, f"k{i}"): i for i in range(9)}, **{(2, f"k{i}"): i for i in range(6)}}


def linked_by_hand(rows):
    """conv_id, call_id, turn, place -> duplicate, level, number of results."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        calls = [(r[1], k, c) for r in own if r[2] == "assistant" and r[3].startswith("{") for k, c in enumerate(json.loads(r[3])["tool_calls"])]
        first, level = {}, {}
        for turn, k, c in calls:
            first.setdefault(c["id"], (turn, k, c))
        results = Counter(json.loads(r[3])["tool_call_id"] for r in own if r[2] == "tool")
        changed = True
        while changed:
            changed = False
            for i, (_, _, c) in first.items():
                before = [x for x in c["depends_on"] if x in first]
                if i not in level and all(x in level for x in before):
                    level[i], changed = max([level[x] + 1 for x in before], default=0), True
        for turn, k, c in calls:
            out[conv, c["id"], turn, k] = (first[c["id"]][:2] != (turn, k), level.get(c["id"]), results[c["id"]])
    return out


def test_linking_against_a_linker_by_hand(spark):
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(1500)]:
        for turn in range(rng.randint(1, 40 if conv is None else 6)):
            kind = rng.random()
            ids = [f"c{rng.randint(0, 9)}" for _ in range(rng.randint(1, 4))]
            if kind < 0.5:
                calls = [{"id": i, "name": "t", "arguments": "{}", "depends_on": [f"c{rng.randint(0, 9)}" for _ in range(rng.randint(0, 2))]} for i in ids]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            elif kind < 0.8:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": ids[0], "content": "x"})))
            else:
                rows.append((conv, turn, "user", "plain"))
    df = turns(spark, rows).repartition(5)
    got = {(r["conv_id"], r["call_id"], r["turn"], r["place"]): (r["duplicate"], r["level"], r["n_results"]) for r in chat.link(chat.parse(df)).collect()}
    assert got == linked_by_hand(rows)
    places = {}
    for r in chat.format_messages(df).collect():
        places.setdefault(r["conv_id"], []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and sum(map(len, places.values())) == len(rows)


@pytest.mark.parametrize(("value", "schema", "n"), [(1.0, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), ("abc", {"type": ["string", "null"], "maxLength": 2}, 1), ([1, "a"], {"items": {"type": "number"}}, 1), ({"a": {"b": 1}}, {"properties": {"a": {"required": ["c"]}}}, 1), (3, {"enum": [1, 2]}, 1)])
def test_schema_faults(value, schema, n):
    assert len(chat.faults(value, schema)) == n


@pytest.mark.parametrize("alone", [False, True])
def test_warc_round_trip(spark, tmp_path, alone):
    bodies = ["<p>a</p>", "b\r\n", "\r\n\r\n", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nx", "é漢" * 500, "", None, "<p>a</p>", "x" * 100_000, "\r\n\r\nWARC/1.1"]
    rows = [(10 - i, f"http://h/{i}", b) for i, b in enumerate(bodies)] + [(100, None, "b\r\n"), (None, "u", "b\r\n"), (None, None, "alone"), (7, "http://h/3", bodies[3])]
    rows = [r for k, r in enumerate(rows) if not alone or r[0] not in [x[0] for x in rows[:k]]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.archive(df, path)
    records = warc.read_archive(spark, path)
    headers, payloads = warc.content_store(records)
    assert records.count() == len(rows) and payloads.count() == len({b or "" for *_, b in rows})
    whole = warc.reconstruct(headers, payloads).collect()
    assert sorted(((r["page_id"], r["url"], r["payload"]) for r in whole), key=str) == sorted(((i, u, b or "") for i, u, b in rows), key=str)
    for r in whole:
        digest = base64.b32encode(hashlib.sha1(r["payload"].encode()).digest()).decode()
        assert f"WARC-Payload-Digest: sha1:{digest}\r\n" in r["header"] and r["header"].startswith("WARC/1.1\r\nWARC-Type: ")
        least = min((i for i, _, b in rows if (b or "") == r["payload"] and i is not None), default=None)
        assert ("WARC-Type: revisit" in r["header"]) == (least is not None and r["page_id"] != least)
    warc.archive(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0
    extra = df.withColumns({n: lit("clash") for n in ("id", "key", "body", "header", "http", "n", "x", "count")})
    warc.archive(extra, str(tmp_path / "x"))
    assert sorted(r["header"] for r in warc.read_archive(spark, str(tmp_path / "x")).collect()) == sorted(r["header"] for r in records.collect())
    bad = records.withColumn("payload", records.payload.substr(2, 1000))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.content_store(bad)[1].collect()


def test_warc_digests_without_payloads(spark, tmp_path):
    """Who reads digests and lengths alone shuffles no payload, and yet each payload has been held against its digest."""
    bodies = ["<p>a</p>", "é漢" * 500, "", "\r\n\r\nWARC/1.1"]
    df = spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in enumerate([*bodies, bodies[0]])] + [(None, None, "alone"), (None, None, "alone")], "page_id long, url string, html string")
    warc.archive(df, str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    digests = warc.content_store(records)[1].select("key", "sha1", "payload_bytes")
    assert "first(payload#" not in digests._jdf.queryExecution().optimizedPlan().toString()
    hashed = lambda b: (hashlib.sha256(b).hexdigest(), base64.b32encode(hashlib.sha1(b).digest()).decode(), len(b))
    assert sorted(tuple(r) for r in digests.collect()) == sorted(hashed(b.encode()) for b in [*bodies, "alone"])
    bad = records.withColumn("payload", records.payload.substr(2, 1000))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.content_store(bad)[1].select("key", "sha1").collect()
