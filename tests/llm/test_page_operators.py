"""Operators on pages and conversations: brute force, round trips and odd rows."""

import base64
import hashlib
import html as htmllib
import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from gridlens.llm import chat, urls, warc, wrapper
from llm_tables import SMALL


# ------------------------------------------------------------------ operator 1
def _parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path, rules):
    fits = [(len(r), r, v) for v, r in rules for h, p in [(r[:r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_parsing(spark):
    from gridlens.llm.queries import RULES
    rows = E.queries()["op1_url_filters"](spark, SMALL).collect()
    source = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert {r.page_id for r in rows} == set(source) and len(rows) == len(source)
    for r in rows:
        host, path = _parse(source[r.page_id])
        rule, verdict = _rule(host, path, RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)


def test_url_odd_rows(spark):
    odd = [None, "", "no scheme/x", "HTTP://A.É.Com?x=1", "a://b", "x://h\n/p\n#f", "s://h/a://b", "s://h/" + "d/" * 30]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(odd)] + [(None, "s://h/", "c")], "page_id long, url string, node string")
    rows = urls.filter_urls(df).collect()
    assert len(rows) == len(odd) + 1
    for r in rows:
        assert (r.host, r.path) == _parse(odd[r.page_id] if r.page_id is not None else "s://h/") and r.verdict == "allow"
    assert next(r for r in rows if r.page_id == 7).template.endswith("/**")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_templates(spark):
    """Numbers become wildcards, alike branches merge, a branch of bad pages is blocked and stays apart."""
    rows, labels, n = [], [], 0
    for lang in ("en", "fr", "de"):
        for i in range(60):
            rows.append((n, f"http://h.example/{lang}/{i * 7919}"))
            labels.append((n, 1, 0))
            n += 1
    for i in range(60):
        rows.append((n, f"http://h.example/spam/{i * 104729}"))
        labels.append((n, 0, 0))
        n += 1
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    spam = {(r.template, r.verdict) for r in out if "/spam/" in r.path}
    rest = {(r.template, r.verdict) for r in out if "/spam/" not in r.path}
    assert spam == {("h.example/spam/{9}", "block")}
    assert rest == {("h.example/~/{9}", "allow")} or all(t.endswith("/{9}") and v == "allow" for t, v in rest)


def test_urls_of_deep_sections(spark):
    """Sections below the eighth segment have templates of their own, also far below."""
    rows, labels = [], []
    for prefix in ("/a/b/c/d/e/f/g/h", "/x" * 40):
        for section, bad in (("good", 0), ("spam", 1), ("fine", 0), ("more", 0)):
            for i in range(60):
                rows.append((len(rows), f"http://deep.example{prefix}/{section}/{i * 7919}"))
                labels.append((len(labels), 1 - bad, bad))
    rows += [(len(rows) + i, "http://deep.example/a/b/c/d/e/f/g/h/rare/1/2") for i in range(3)]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) == len({r.page_id for r in out})
    for r in out:
        assert r.verdict == ("block" if "/spam/" in r.path else "allow")
        assert r.template.endswith("/**" if "/rare/" in r.path else "/{9}")
    assert {r.template for r in out if "/spam/" in r.path} == {"deep.example" + "/~" * 8 + "/spam/{9}", "deep.example" + "/~" * 8 + "/x" * 32 + "/spam/{9}"}


# ------------------------------------------------------------------ operator 2
def test_chats(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    marks = "</s>[INST] ok [/INST]"
    want = {}
    for conv, turns in groupby([(-1, 0, "user", marks), (-1, 1, "assistant", marks), *rows], key=lambda r: r[0]):
        turns = list(turns)
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3] or ''}\n" for t in turns)
        want[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in E.queries()["op2_chat_formatting"](spark, SMALL).collect()}
    assert got == want


def test_chat_round_trips_and_spans():
    rng = random.Random(1)
    parts = [*chat.CONTROL, " ", "\\", "<", "[", "/", "s>", "INST]", "x", "\n", "]", "TURN ", " [/", "é"]
    for n in range(800):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool x", "</s>", "a] b"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(90 if n % 80 == 0 else rng.randint(0, 4))]
        whole, spans, rewriting = chat.locate(chat.render, turns)
        assert chat.read_back(whole) == turns and not rewriting
        for (_, text), (a, b, x, y) in zip(turns, spans):
            assert a <= x <= y <= b and chat.unescape(whole[x:y]) == text
            assert not any(c in whole[x:y] for c in chat.CONTROL)


def test_templates_that_rewrite_history():
    def last_in_full(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t[:3]}" for i, (r, t) in enumerate(turns))

    whole, spans, rewriting = chat.locate(last_in_full, [("u", "hello"), ("a", "world"), ("u", "x")])
    assert whole == "<u>hel<a>wor<u>x" and rewriting == [1, 2]
    _, spans, rewriting = chat.locate(lambda turns: "".join(f"[{r}]{t.strip()}" for r, t in turns), [("u", " a "), ("a", "b")])
    assert rewriting == [] and spans[0][2:] == (3, 4) and spans[1][2:] == (7, 8)  # the text as it is shown


def test_templates_that_rewrite_history_at_a_longer_prefix(spark):
    def at_fifty(turns):
        return ("<long>" if len(turns) == 50 else "") + "".join(f"[{r}]{t}" for r, t in turns)

    turns = [("u" if i % 2 else "a", f"turn {i}") for i in range(80)]
    whole, _, rewriting = chat.locate(at_fifty, turns)
    assert whole == at_fifty(turns) and rewriting == [49, 50]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(rows, at_fifty).first().rewrites == [49, 50]


def test_chat_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (1, None, "user", None), (1, 2, None, "b"), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 1, 1: 4, 2: 1} and got[2].loss_chars == 100_000
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


# ------------------------------------------------------------------ operator 8
def test_warc_round_trip(spark):
    rows = E.queries()["op8_warc"](spark, SMALL).collect()
    source = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    last = {}
    for i, b in source.items():
        last[b] = max(i, last.get(b, i))
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in source.items()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want


@pytest.mark.parametrize("split", [11, 300, 1 << 20])
def test_warc_splits_and_revisits(spark, tmp_path, split):
    inner = warc.member(warc.page_record(77, "u", b"inside", None)).decode("latin-1")
    rows = [(1, "a b\r\n", "<p>x"), (2, "b", "<p>x"), (5, "c", "<p>x"), (3, None, None), (4, "d", ""), (7, "e", "y" * 50_000), (None, "z", "<p>x"), (9, "q", "\x1f\x8b\x08" * 50 + inner), (9, "q", "\x1f\x8b\x08" * 50 + inner)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    made = warc.write_archives(warc.with_revisits(df).repartition(2), folder).collect()
    assert sum(m.records for m in made) == len(rows)
    got = warc.read_archives(spark, folder, split).filter("record_type <> 'warcinfo'").collect()
    brief = sorted((r.record_id, r.record_type, r.payload_bytes, r.refers_to or "") for r in got)
    assert brief == sorted([("urn:page:", "response", 4, ""), ("urn:page:1", "revisit", 4, "urn:page:5"), ("urn:page:2", "revisit", 4, "urn:page:5"), ("urn:page:3", "revisit", 0, "urn:page:4"),
                            ("urn:page:4", "response", 0, ""), ("urn:page:5", "response", 4, ""), ("urn:page:7", "response", 50_000, ""), *[("urn:page:9", "response", len(("\x1f\x8b\x08" * 50 + inner).encode()), "")] * 2])
    assert {r.record_id: r.target_uri for r in got}["urn:page:1"] == "a%20b%0D%0A"


def test_warc_stored_inside_a_payload():
    """Members inside an uncompressed payload aren't records of the outer archive."""
    inner = warc.member(warc.page_record(7, "u", b"inner", None)) * 3
    outer = warc.member(warc.record("resource", "urn:x:1", [], inner), 0) + warc.member(warc.page_record(2, "v", b"two", None))

    class Bytes:
        def seek(self, at): self.at = at
        def read(self, n): return outer[self.at:self.at + n]

    ids = [f["warc-record-id"] for a in range(0, len(outer), 4096) for _, f, _ in warc.records_of(warc.Window(Bytes(), len(outer)), a, min(a + 4096, len(outer)))]
    assert ids == ["<urn:x:1>", "<urn:page:2>"]


def test_warc_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(warc.with_revisits(empty), folder).agg(F.sum("records")).first()[0] is None
    assert warc.read_archives(spark, folder).count() == 0


# ------------------------------------------------------------------ operator 9
def test_extraction(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in E.queries()["op9_html_extraction"](spark, SMALL).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", "\n")
        parts = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d)>", article)]
        assert got[i].text == "\n\n".join(x for x in parts if x) and got[i].n_chars == len(got[i].text)


def test_blocks_of_odd_pages():
    def text(page):
        return wrapper.blocks(wrapper.parse(page), None)

    assert text("<header>x</header><div class='cookie-notice'>n</div><p>One&nbsp;two <b>three</b><p>four<ul><li>a<li>b</ul><section id=comments><p>c</section><aside>z</aside>") == ["One two three", "four", "a", "b"]
    assert text("<nav>n</nav><main><h1>T</h1><form>f</form><p>a <!-- <p>x --> b<script>if (a</p>) {}</script></main><footer>f</footer>") == ["T", "a b"]
    assert text("") == [] and text("plain & &lt;text&gt;") == ["plain & <text>"] and text("<p>a<br>b</p>a < b <") == ["a b", "a < b <"]
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == ["deep"]
    assert text("<p>cut <a href='x") == ["cut"]


def test_words_of_class_and_id_are_hints_only():
    def text(page):
        return wrapper.blocks(wrapper.parse(page), None)

    long = "a long story " * 9
    want = [" ".join(long.split())]
    assert text(f"<html class='no-widget'><body class='single has-sidebar'><p>{long}</p><div class=sidebar>s</div></body></html>") == want
    assert text(f"<body><article class='post comments-open'><p>{long}</p><div id=comments>c</div></article></body>") == want
    assert text(f"<div class='wrap has-sidebar'><div class='share-enabled'><p>{long}</p></div><div class=related><p>r</div></div>") == want
    assert text(f"<div id=page class=social><main class=header><p>{long}</p></main></div><p>{'outside ' * 99}</p>") == want
    assert text(f"<div class='widget-area'><article><p>short</p></article></div><div>{long}</div>") == ["short"]
    assert text(f"<article><p>{long}</p><div class=comments><p>{long} one</p></div></article>") == want  # after the text
    assert text(f"<article><header class=entry-header><nav>n</nav><h1>Title</h1><p>by me</p></header><p>{long}</p></article>") == ["Title", *want]
    assert text(f"<article><div class=post-header><h2 class=header>Title</h2><span>1 May</span></div><p>{long}</p></article>") == ["Title", *want]


def test_wrapper_finds_constant_nodes(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=kicker>Daily news of h</div><div class=body><p>Story {i}</p><p>{'text ' * i}</p></div><div class=tail>Printed by us</div></body>") for i in range(1, 9)]
    rows += [(100, "http://other.example/", "<body><div class=kicker>Only page</div></body>"), (101, None, None), (None, "http://h.example/x", "<p>x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrapper.extract(df).collect()}
    assert got[3] == "Story 3\n\ntext text text" and got[100] == "Only page" and got[101] == "" and got[None] == "x"
    assert wrapper.extract(df.limit(0)).count() == 0


def test_template_of_pages_with_many_nodes(spark):
    """Over 400 nodes that one page has, and a constant node that stands on 60 % of pages."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    def page(i):
        own = "".join(f"<p class={word(1000 * i + j)}>story {i} {j}</p>" for j in range(450))
        return f"<body><div class=kicker>Daily news of h</div>{own}" + "<div class=tail>Printed by us</div>" * (i % 5 > 1) + "</body>"

    rows = [(i, "http://h.example/", page(i)) for i in range(10)]
    want = {i: "\n\n".join(f"story {i} {j}" for j in range(450)) for i in range(10)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (10, 2):
        assert {r.page_id: r.text for r in wrapper.extract(df.repartition(n)).collect()} == want


def test_copies_of_a_page_make_no_template(spark):
    page = "<body><div class=kicker>Daily</div><article>Directly here<div>Main text in a div</div><font>and here</font></article></body>"
    rows = [(i, "http://copies.example/", page.replace("Daily", f"Daily {i}" if i % 2 else "Daily")) for i in range(9)]
    rows += [(10 + i, "http://mixed.example/", f"<body><div class=kicker>Daily</div><div class=text>Story {max(i, 6)}</div></body>") for i in range(10)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(9)} == {"Directly here\n\nMain text in a div\n\nand here"}
    assert got[10] == "Story 6" and got[19] == "Story 9"  # four articles share the kicker


def test_template_without_article_or_telling_names(spark):
    """Plain ``div`` pages: constant siblings go, a varying sibling of the same label stays; optional parts shift places."""
    def page(i):
        promo = "<div><p>Buy now</p></div>" * (i % 2)
        return (f"<body><div><div>The Daily</div><ul><li>Home</li><li>About</li></ul></div>{promo}<div><h1>Story {i}</h1><h2>Summary</h2><p>{'text ' * i}</p>"
                f"<p>end {i}</p></div><div><p>Printed by us</p><table><tr><td>Terms</td></tr></table></div></body>")

    rows = [(i, "http://plain.example/", page(i)) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i}\n\nSummary\n\n{' '.join(['text'] * i)}\n\nend {i}" for i in range(1, 13)}
    for n in (7, 2):
        assert {r.page_id: r.text for r in wrapper.extract(df.repartition(n)).collect()} == want


def _tree_of(tree):
    """(labels, depths) in page order of (label, children ..)."""
    out, todo = ([], []), [(tree, 0)]
    while todo:
        (label, *kids), depth = todo.pop()
        out[0].append(label)
        out[1].append(depth)
        todo.extend((k, depth + 1) for k in reversed(kids))
    return out


def _most(a, b):
    """Nodes paired by simple tree matching, by its plain recursion."""
    if a[0] != b[0]:
        return 0
    x, y = a[1:], b[1:]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + _most(x[i], y[j]))
    return 1 + best[-1][-1]


def test_simple_tree_matching():
    a = (1, (2, (5,)), (3,), (4,))
    b = (1, (3,), (2, (5,), (6,)), (4,))
    aligner = wrapper.Aligner(*_tree_of(a))
    places = aligner.places(*_tree_of(b))
    assert places[0] == 0 and places[2:4] == [1, 2] and places[5] == 4 and not {places[1], places[4]} & set(range(5))
    draw = random.Random(7)

    def grow(depth):
        return (draw.randrange(1, 4), *(grow(depth - 1) for _ in range(draw.randrange(5) if depth else 0)))

    for _ in range(300):
        a, b = (1, *grow(4)[1:]), (1, *grow(4)[1:])
        aligner = wrapper.Aligner(*_tree_of(a))
        places = aligner.places(*_tree_of(b))
        assert sum(0 <= p < len(_tree_of(a)[0]) for p in places) == _most(a, b) and len(set(places)) == len(places)
        labels = _tree_of(a)[0]
        assert all(labels[p] == q for p, q in zip(places, _tree_of(b)[0]) if 0 <= p < len(labels))


def test_long_rows_of_different_siblings():
    """3000 siblings of many shapes: matched as a whole, in linear memory; same trees match entirely."""
    draw = random.Random(3)
    row = lambda: (1, *((2, *((draw.randrange(3, 6),) for _ in range(draw.randrange(4)))) for _ in range(3000)))
    a, b = _tree_of(row()), _tree_of(row())
    aligner = wrapper.Aligner(*a)
    assert aligner.places(*a) == list(range(len(a[0])))
    assert sum(0 <= p < len(a[0]) for p in aligner.places(*b)) > 5000

