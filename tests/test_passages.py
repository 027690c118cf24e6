"""Offsets, source texts and the rate limiter against plain Python."""

import hashlib
import html

from pyspark.sql import functions as F

from sparkquill.operators import passages
from sparkquill.sources.tables import read
from sparkquill.streaming import events, state

DIR = "/root/testdata/sf0.001"


def test_origins_name_the_raw_characters():
    raw = "A  B\n\nC-\nd — e f"
    text, origin = passages.with_origins(raw, set())
    assert text == "A B Cd - e f" and len(origin) == len(text) and origin == sorted(set(origin))
    assert all(a == raw[i] or raw[i].isspace() or raw[i] == "—" for a, i in zip(text, origin))
    assert passages.with_origins("", set()) == ("", []) and passages.with_origins(" \n ", set()) == ("", [])


def test_removed_lines_are_not_read():
    assert passages.with_origins("12\nkept\n13", {0, 2})[0] == "kept"


def read_plainly(page):
    """The text of a source by going over its characters: comments and tags go, a line begins before some of these."""
    import html

    if "<" not in page:
        return page.strip()
    bare, at = [], 0
    while at < len(page):  # comments that end
        end = page.find("-->", at + 4) if page.startswith("<!--", at) else -1
        if end >= 0:
            at = end + 3
        else:
            bare.append(page[at])
            at += 1
    rest, out, at = "".join(bare), [], 0
    while at < len(rest):
        close = rest.find(">", at)
        name = rest[at + 1 : at + 2] == "/" and at + 2 or at + 1
        if rest[at] == "<" and close >= 0 and name < len(rest) and (rest[name].isascii() and rest[name].isalpha() or rest[name] == "!"):
            stop = name
            while stop < len(rest) and rest[stop].isascii() and rest[stop].isalnum():
                stop += 1
            if name == at + 1 and rest[name:stop].lower() in ("p", "br", "div", "li", "blockquote", "h1", "h2", "h3", "h4") and rest[stop] in " \t\n\r\f\v/>":
                out.append("\n")
            at = close + 1
        else:
            out.append(rest[at])
            at += 1
    return html.unescape("".join(out)).strip()


def test_source_texts_of_pages_against_a_plain_reader(spark):
    """All pages, and pages with broken marks."""
    rows = read(spark, DIR, "pages").select("page_id", "html").collect()
    got = {r["page_id"]: (r["n_chars"], r["sha256"]) for r in passages.html_clean(spark, DIR).collect()}
    want = {r["page_id"]: read_plainly(r["html"]) for r in rows}
    assert got == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in want.items()}
    odd = ["a < b <p>c", "<P class='x>y'>t", "<!-- <p>x</p> --> y <!-- z", "<pre>a</pre><p/>b<br/>c<h5>d</h5><h2 >e", "</p>x</>y<!DOCTYPE html>z", "&lt;p&gt; &amp;amp; <i>q</i>", "no marks &amp;", "<>", "<", "a<1>b", ""]
    df = spark.createDataFrame([(t,) for t in odd], "html string")
    assert [r[0] for r in df.select(passages.source_text(F.col("html"))).collect()] == [read_plainly(t) for t in odd]


def folded(rows):
    """Outcomes of (user, event, at, amount) by plain lists."""
    window, out = {}, {}
    for user, event, at, amount in sorted(rows, key=lambda r: (r[2], r[1])):
        size = state.SECONDS * 1_000_000
        held = window[user] = [(t, n) for t, n in window.get(user, []) if at - t < size]
        if amount > state.CAPACITY:
            out[event] = ("error", at)
        elif sum(n for _, n in held) + amount > state.CAPACITY:
            out[event] = ("refused", held[0][0] + size)
        else:
            out[event] = ("admitted", at)
            held += [(at, amount)] * (amount > 0)
    return out


def test_rate_limit_matches_a_plain_fold(spark):
    got = {r["event_id"]: (r["outcome"], r["available"]) for r in events.streaming_rate_limit(spark, DIR).collect()}
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = [tuple(r) for r in read(spark, DIR, "events").select("user_id", "event_id", at, F.col("event_id") % 14).collect()]
    want = folded(rows)
    assert got == want and {x for x, _ in want.values()} == {"admitted", "refused", "error"}


def test_rate_limit_over_several_batches(spark, tmp_path, monkeypatch):
    """Windows go from one batch to the next; each file is a batch here."""
    monkeypatch.setattr(events, "FILES", 1)
    whole = read(spark, DIR, "events").orderBy("ts", "event_id").limit(900).collect()
    for i in range(3):
        spark.createDataFrame(whole[300 * i : 300 * (i + 1)], events.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["outcome"] for r in events.streaming_rate_limit(spark, str(tmp_path)).collect()}
    times = spark.createDataFrame(whole, events.SCHEMA).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 14)
    assert got == {k: v[0] for k, v in folded([tuple(r) for r in times.collect()]).items()}


def test_feed_over_several_batches(spark, tmp_path, monkeypatch):
    """The ends of keys go from one batch to the next; each file is a batch here, and files are in order of time."""
    monkeypatch.setattr(events, "FILES", 1)
    whole = read(spark, DIR, "events").where("ts >= '2024-01-10'").orderBy("ts", "event_id").limit(600).collect()
    for i in range(3):
        spark.createDataFrame(whole[200 * i : 200 * (i + 1)], events.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    ended, want = set(), set()
    for r in whole:
        if r["user_id"] not in ended:
            want.add(r["event_id"])
        if r["event_type"] in state.TERMINAL:
            ended.add(r["user_id"])
    assert {r["event_id"] for r in events.streaming_feed(spark, str(tmp_path)).collect()} == want and 0 < len(want) < 600


def test_window_of_a_key():
    w = state.Window()
    day = state.SECONDS * 1_000_000
    assert w.ask(0, state.CAPACITY + 1)[0] == w.ask(0, -1)[0] == "error" and w.ask(0, 0) == ("admitted", 0)
    assert w.ask(5, state.CAPACITY) == ("admitted", 5) and w.ask(6, 1) == ("refused", 5 + day) and w.ask(5 + day, 1) == ("admitted", 5 + day)


def test_places_of_claims(spark):
    rows = [("A rule (see x) [1] holds.", "rule  (see x) [1]"), ("a\\E b", "a\\E b"), (None, "x"), ("x", None), ("x", ""), ("cost $1 a.b", "COST $1 A.B"), ("axb", "a.b")]
    df = spark.createDataFrame(rows, "excerpt string, claim string")
    got = [(r["safe"], r["lo"], r["hi"]) for r in passages.located(df).collect()]
    assert got == [(True, 2, 18), (True, 0, 5), (False, None, None), (False, None, None), (False, None, None), (True, 0, 11), (False, None, None)]
    assert passages.located(df.limit(0)).count() == 0


def test_scores_of_odd_answers(spark):
    df = spark.createDataFrame([(None,), ("no JSON",), ("[]",), ('{"p": 1}',), ('{"p": -0.1}',), ('{"documents": [1], "p": 0.5}',)], "answer string")
    assert [r["x"] for r in passages.scores_of(df, {"x": "p"}).collect()] == [None, None, None, 1.0, None, 0.5]


def test_running_lines(spark):
    rows = [
        ("d", 1, "HEAD one\nbody\n12"), ("d", 2, " head ONE \nother\n\nfoot"), ("d", 3, "only\nfoot"), ("d", 3, "only"), ("e", 1, "HEAD one\nx"), ("d", 4, "abc\nbody"), ("d", 5, "abc"),
        ("d", 6, ""), ("d", 7, None), (None, 8, "HEAD one"), ("d", 9, "HEAD one"), ("d", None, "HEAD one"),
    ]
    pages = spark.createDataFrame(rows, "doc string, page int, text string")
    got = sorted((r["doc"], r["page"], r["removed"]) for r in passages.running_lines(pages).collect())
    assert got == [("d", 1, [0]), ("d", 2, [0, 3]), ("d", 3, [1]), ("d", 9, [0])]
    assert passages.running_lines(pages.limit(0)).count() == 0
    kept = {(r["doc"], r["page"]): r["p"]["text"] for r in passages.normal_pages(pages.where("page <> 3")).collect()}
    assert kept["d", 1] == "body 12" and kept["d", 9] == "" and kept["e", 1] == "HEAD one x" and kept["d", 2] == "other foot"


def test_first_and_last_lines_are_counted_from_the_page(spark):
    from sparkquill.operators.offsets import cited_pages

    pages = [("d", 1, " \n\t\n  Head Line \nbody\n\n Foot\u00a0line\n\n"), ("d", 2, "head line\nmore\nFOOT LINE "), ("d", 3, "only line"), ("d", 4, None), ("d", 5, " \n "), ("d", 6, "head line"), (None, 1, "head line")]
    df = spark.createDataFrame(pages, "doc string, page int, text string")
    got = {(r["doc"], r["page"]): r["removed"] for r in passages.running_lines(df).collect()}
    assert got == {("d", 1): [2], ("d", 2): [0], ("d", 6): [0]}
    assert cited_pages(df).count() == 0


def test_pages_are_worked_on_in_stretches(monkeypatch, spark):
    """A batch of long pages is taken in stretches of a bounded length, with a row for each page; a page's form needs no objects of single characters."""
    import tracemalloc

    import pyarrow as pa

    texts = ["a  b" * 50, None, "", "c\n" * 400, "d"] * 20
    monkeypatch.setattr(passages, "CHARS", 500)
    parts = [x for x, _ in passages.few(pa.array(texts), pa.array([None] * len(texts), pa.list_(pa.int32())))]
    assert [t for p in parts for t in p] == texts and len(parts) > 20
    tracemalloc.start()
    passages.normal_origins("word  word\n" * 20_000, {1, 3})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * 220_000


def test_citations_are_read_once(spark, tmp_path):
    """Pages are gone over a single time, whatever number of joins the antecedents take."""
    from sparkquill.operators.citations import antecedents, extract

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        seen.add(1)
        return x

    pages = spark.createDataFrame([(i, 1, "Roe v. Wade, 410 U.S. 113 (1973). Roe, 410 U.S. at 120. Id. at 121.") for i in range(40)], "doc_id int, page int, text string").localCheckpoint()
    found = antecedents(extract(pages.withColumn("text", told("text")), skip_tables=False)).collect()
    assert len(found) == 120 and {(r["kind"], r["root"]) for r in found} == {("full", None), ("short", 1), ("id", 1)}
    assert seen.value == 40


def test_only_references_go_through_python(spark):
    """Texts stay with Spark; what is decoded is what html.unescape decodes, those at the ends and in a row too."""
    odd = ["&amp;", "a &amp;&lt;b&gt; &notit; &#65;&#x42; &#128; &#xD800; & &; &nosuch; &copy x&hellip", "&&amp;amp;", "", "no", "\U0001f600&eacute;\U0001f600&#1114112;" + "&" + "x" * 40, None]
    df = spark.createDataFrame([(x,) for x in odd], "x string").select("x", passages.unescaped(F.col("x")).alias("y"))
    assert [(r.x, r.y) for r in df.collect()] == [(x, None if x is None else html.unescape(x)) for x in odd]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [decoded(regexp_extract_all(" in plan, plan
