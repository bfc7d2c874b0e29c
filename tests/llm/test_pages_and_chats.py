import hashlib
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from kataflow.llm import chat, html
from kataflow.llm.queries import CONTROL

PAGE = (
    '<html><head><title>T</title></head><body><header><div class="logo">Site</div></header><div id="menu"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>'
    '<div class="wrap"><div class="col-{i}"><h1>T{i}</h1><p>Body <b>num</b>ber {i} &amp; more&nbsp;&#233;.<br>x<div class="share">Share</div><p>Second {j}<script>if(a<b) x="</p>"</script></div><aside>Side {i}</aside></div>'
    '<div class="comments"><p>Nice {i}</p></div><form><p>Name {i}</p></form><!-- c --><footer>(c) {i}</footer></body></html>'
)


def frame(spark, pages):
    return spark.createDataFrame([(i, u, h, "old") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")


def test_extraction(spark, monkeypatch):
    odd = [("http://a.com/x", None), (None, "<p>alone"), ("http://b.com", ""), ("http://c.com", "<div>" * 3000 + "deep"), ("http://d.com", 'plain < text > a<b "q'), ("http://e.com", "<p>" + "long " * 50_000)]
    pages = [(f"http://A.com/{i}", PAGE.format(i=i, j=7 * i)) for i in range(6)] * 2 + odd
    want = [f"T{i} Body number {i} & more é. x Second {7 * i}" for i in range(6)] * 2 + ["", "alone", "", "deep", 'plain < text > a<b "q', ("long " * 50_000).strip()]
    got = html.extract(frame(spark, pages))
    assert [r.text for r in got.orderBy("page_id").collect()] == want and sorted(got.columns) == ["html", "page_id", "text", "url"]
    monkeypatch.setattr(html, "BROADCAST_CHARS", -1)
    assert [r.text for r in html.extract(frame(spark, pages)).orderBy("page_id").collect()] == want
    assert html.extract(frame(spark, pages).limit(0)).count() == 0


def test_classes_of_any_block(spark):
    page = (
        '<body class="has-comments"><div class="content with-sidebar"><p>One {0}<p class="ad">Buy now<p>Two {0} <ul class="related"><li>x<li>y</ul><ul><li>a<li class="share">s<li>b</ul>'
        '<div class="elementor-widget-text">Three {0}</div><div class="cookie-notice">We</div><h2 hidden>No</h2><table><tr><td>c<td>d</table></div><div id="comments"><article class="comment">Nice</article></div></body>'
    )
    got = html.extract(frame(spark, [("http://j.org/", page.format(i)) for i in range(3)]))
    assert [r.text for r in got.orderBy("page_id").collect()] == [f"One {i} Two {i} a b Three {i} c d" for i in range(3)]


def test_article_first(spark):
    page = '<body><nav>menu</nav><div class="ad">Buy</div><article><h1>H{0}</h1><p><b>One {0}<br><p>Two</article><div class="story">teaser {0} {0} {0} {0} {0} {0} {0}</div><footer>f'
    got = html.extract(frame(spark, [("http://h.org/", page.format(i)) for i in range(3)]))
    assert [r.text for r in got.orderBy("page_id").collect()] == [f"H{i} One {i} Two" for i in range(3)]


def test_articles_with_words_of_their_own(spark):
    page = '<body><div class="meta">Views {0}</div><article class="post tag-{1}" id="post-{1}"><p>About {1}<p>More on {1}</article><footer>f'
    names = ["red", "green", "blue", "grey"]
    got = html.extract(frame(spark, [("http://k.org/", page.format(i, w)) for i, w in enumerate(names)]))
    assert [r.text for r in got.orderBy("page_id").collect()] == [f"About {w} More on {w}" for w in names]


def test_copies_of_an_article(spark):
    page = '<body><div class="meta">Views {0}</div><article><p>The same story<p>to its end</article><footer>f'
    got = html.extract(frame(spark, [("http://l.org/", page.format(i)) for i in range(4)]))
    assert [r.text for r in got.collect()] == ["The same story to its end"] * 4


def test_containers_of_single_pages_count(spark):
    page = '<body><div class="stamp">On {0}</div><div class="story-{1}"><p>A long text about {1} and what it is</div><footer>f'
    got = html.extract(frame(spark, [("http://m.org/", page.format(i, w)) for i, w in enumerate(["red", "green", "blue"])]))
    assert [f"A long text about {w} and what it is" in r.text for w, r in zip(["red", "green", "blue"], got.orderBy("page_id").collect(), strict=True)] == [True] * 3


def test_contents_of_other_elements_stay(spark):
    page = '<body><article><p>Sum {0} <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math> <noscript>plain</noscript> <button>press<p>after</p><video src=v>no video<p>end {0}</article>'
    got = html.extract(frame(spark, [("http://n.org/", page.format(i)) for i in range(3)]))
    assert [r.text for r in got.orderBy("page_id").collect()] == [f"Sum {i} x = {i} plain press after no video end {i}" for i in range(3)]


PLAIN = (
    "<body><div><p>Seen {0} times<div><p>Line {1}</div></div><div><h2>Title {0}</h2><section><p>{2}</p><p>Thank you for reading us</p><p>{3}</p></section></div>"
    "<div><p>Written on day {1}</div>"
)


def plain_pages(n):
    rng = random.Random(3)
    body = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    rows = [(i, 7 * i, body(), body()) for i in range(n)]
    return [("http://plain.org/", PLAIN.format(*r)) for r in rows], [f"Title {i} {a} {b}" for i, _, a, b in rows]


def test_the_wrapper_alone_finds_the_text(spark, monkeypatch):
    """No article, no class, three containers of the same path: the wrapper's place and what its slots take in decide."""
    pages, want = plain_pages(12)
    got = [r.text for r in html.extract(frame(spark, pages)).orderBy("page_id").collect()]
    assert got == want
    # A page by itself can't tell the line that all pages have.
    assert [html.Rule('{"wrapper": []}').text_of(html.Page(h)) for _, h in pages] != want


def test_a_host_of_copies_keeps_its_text(spark):
    pages, want = plain_pages(1)
    got = [r.text for r in html.extract(frame(spark, pages * 9)).collect()]
    assert len(set(got)) == 1 and want[0].split("Title 0 ")[1][:100] in got[0]


def test_deep_pages_need_linear_memory(spark):
    deep = ["<div>" * 100_000 + "deep", "<div><section>" * 50_000 + "deep<p>er" + "</section></div>" * 50_000 + "end"]
    got = html.extract(frame(spark, [("http://deep.org/", h) for h in deep]))
    assert [r.text for r in got.orderBy("page_id").collect()] == ["deep", "deep er end"]


def brute(pages):
    """One host after another, all its pages at once."""
    out = {}
    for host in {h for _, h, _ in pages}:
        own = [(i, html.Page(x or "")) for i, h, x in pages if h == host]
        streams = Counter(json.dumps(html.fold(p.stream)) for _, p in own)
        items = html.infer(json.loads(x) for x in sorted(streams, key=lambda x: (-streams[x], x)))
        wrapper, sums, marks = html.Wrapper(items), {}, Counter()
        for _, p in own:
            at, met = wrapper.match(p.stream), set()
            for w, (boiler, blocks) in zip(at, p.slots, strict=True):
                old = sums.get(w, html.Slot(0, True, 0, 0, 0))
                texts = [(html.plain(x), n) for x, n in blocks]
                sums[w] = html.Slot(old.pages + (w not in met), old.boiler and boiler, old.chars + sum(len(t) for t, _ in texts), old.linked + sum(n for _, n in texts), 0)
                marks.update({(w, t) for t, _ in texts if not boiler} - met)
                met |= {w, *((w, t) for t, _ in texts)}
        often = {(w, t) for (w, t), n in marks.items() if n >= max(html.LEAST_PAGES, html.MOST_PAGES * len(own))}
        for _, p in own:
            for w, (boiler, blocks) in zip(wrapper.match(p.stream), p.slots, strict=True):
                if not boiler:
                    sums[w] = sums[w]._replace(fixed=sums[w].fixed + sum(len(t) for x, _ in blocks if (w, t := html.plain(x)) in often))
        take, told = html.choose(wrapper, len(own), {w: s for w, s in sums.items() if w >= 0})
        rule = html.Rule(json.dumps({"wrapper": items, "take": take, "fixed": [[w, [html.mark(t)]] for w, t in often if told and w in take]}))
        out |= {i: rule.text_of(p) for i, p in own}
    return out


def test_many_tasks_find_what_one_does(spark, monkeypatch):
    rng = random.Random(8)
    pages, _ = plain_pages(20)
    pages += [(f"http://a.com/{i}", PAGE.format(i=i, j=7 * i)) for i in range(20)]
    block = lambda i: rng.choice(["<div><p>side {0}</div>", "<section><h2>x{0}<p>many words of {0} and so on</section>", "<ul><li>a<li>b</ul>", "<div><div>in {0}</div></div>"]).format(i)
    pages += [("http://mixed.net/", "<body>" + "".join(block(i) for _ in range(rng.randint(1, 6))) + f"<div><section><p>{' '.join(f'w{rng.randrange(900)}' for _ in range(80))}</section></div>") for i in range(40)]
    df = frame(spark, pages)
    rows = [(r.page_id, r.host, r.html) for r in df.select("page_id", html._host().alias("host"), "html").collect()]
    want = brute(rows)
    for fan_in, chars in ((64, 8_000_000), (64, -1)):
        monkeypatch.setattr(html, "FAN_IN", fan_in)
        monkeypatch.setattr(html, "BROADCAST_CHARS", chars)
        got = {r.page_id: r.text for r in html.extract(df.repartition(5)).collect()}
        assert got == want
    monkeypatch.setattr(html, "FAN_IN", 3)  # several levels of merging
    near = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(near[i] == want[i] for i, host, _ in rows if host != "mixed.net")  # wrappers of chaos depend on the order


def test_wrappers():
    a = ["body", "nav", "#", "/nav", "div.card", "#", "/div.card", "div.card", "#", "/div.card", "/body"]
    b = ["body", "div.card", "#", "/div.card", "aside", "#", "/aside", "/body"]
    card = ["div.card", "#", "/div.card"]
    assert html.fold(a) == ["body", "nav", "#", "/nav", ["+", card], "/body"]
    wrapper = html.infer(iter([a, b]))
    assert wrapper == ["body", ["?", ["nav", "#", "/nav"]], ["+", card], ["?", ["aside", "#", "/aside"]], "/body"]
    assert all(html.align(wrapper, html.fold(x)) == wrapper for x in (a, b, ["body", *card, "/body"]))
    none = html.align(wrapper, ["body", "/body"])
    assert none == ["body", ["?", ["nav", "#", "/nav"]], ["?", [["+", card]]], ["?", ["aside", "#", "/aside"]], "/body"]
    assert all(html.align(none, html.fold(x)) == none for x in (a, b, ["body", *card, "/body"], ["body", "/body"]))


def test_chat_round_trip(spark):
    texts = [CONTROL, "", "\\", "\\h\\l\\n", "a\nb", "</turn>\n### user\n", "🙂 #<\\\\", None]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, None, "x"), (2, None, "role\n#", "y"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.render(chat.fold(chat.log_rows(df)))
    got = {r.conv_id: r for r in made.withColumn("back", chat.parse(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(texts)]
    assert [(t.role, t.text) for t in got[2].back] == [("role\n#", "y"), ("", "x"), ("", "x")]
    digest = {r.conv_id: r for r in chat.digest(made).collect()}
    said = "".join(t or "" for t in texts[1::2])
    assert (digest[1].n_turns, digest[1].loss_chars, digest[1].loss_sha256) == (8, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert digest[1].formatted_chars == len(got[1].formatted) and digest[None].n_turns == 1
    unescape = lambda s: "\\".join(p.replace("\\h", "#").replace("\\l", "<") for p in s.split("\\\\"))
    assert "".join(unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss_spans) == said
    assert chat.digest(chat.render(chat.fold(chat.log_rows(df.limit(0))))).count() == 0
    # The log holds all kinds of events; the loss is what the mask covers, whatever the turns say.
    assert {r.kind for r in chat.log_rows(df).collect()} == {"delta", "edit", "regenerate"}
    first = F.transform(F.slice("loss_spans", 1, 1), lambda x: F.struct((x["start"] - 3).alias("start"), x["end"].alias("end")))
    moved = {r.conv_id: r for r in chat.digest(made.withColumn("loss_spans", first)).collect()}
    assert moved[1].loss_chars == 3 and moved[1].n_turns == 8


def test_marks_of_byte_order_stay(spark):
    rows = [(1, k, "assistant", t) for k, t in enumerate(["\ufeffa", "", "\ufeff", "b\ufeff🙂"])]
    digest = chat.digest(chat.render(chat.fold(chat.log_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).first()
    assert (digest.loss_chars, digest.loss_sha256) == (6, hashlib.sha256("\ufeffa\ufeffb\ufeff🙂".encode()).hexdigest())


def test_events_fold(spark):
    log = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 1, 1, "delta", None, "lo"), (1, 2, 0, "delta", "assistant", "bad"), (1, 2, 1, "regenerate", None, None),
        (1, 2, 2, "delta", None, "go"), (1, 2, 3, "delta", None, "od"), (1, 3, 0, "delta", "user", "x"), (1, 3, 1, "edit", None, "y"), (1, 3, 1, "delta", None, "?"),
    ]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = sorted((r.message, r.role, r.text) for r in chat.fold(df.repartition(4)).collect())
    assert got == [(1, "user", "Hello"), (2, "assistant", "good"), (3, "user", "y")]
