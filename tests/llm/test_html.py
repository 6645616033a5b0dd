import json
import random
import time

from concord.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li><li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1>{body}<aside>Related</aside><form><p>Mail</p></form></article>
<div id="comments"><p>First!</p></div><div class="ad">Buy</div><footer><p>&copy; x</p></footer></body></html>"""


def test_extract(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(body="".join(f"<p>text {k}.{j}\n <b>bold<br>line</b>" for j in range(k % 4 + 1)))) for k in range(12)]
    rows += [(20, "http://h0.example/x", None), (21, None, ""), (22, "http://plain.example/", "<p>one<p>two<nav>menu</nav>"), (0, *rows[0][1:])]
    got = {}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS text")
    found = html.extract(df).collect()
    for r in found:
        got[r["page_id"]] = r
        assert r["n_chars"] == len(r["text"])
    assert len(found) == len(rows)
    for k in range(12):
        assert got[k]["text"] == "\n\n".join(["Head & more", *(f"text {k}.{j} bold line" for j in range(k % 4 + 1))])
    assert got[20]["text"] == got[21]["text"] == ""
    assert got[22]["text"] == "one\n\ntwo"


def accepts(wrapper, tokens):
    """Whether the wrapper, read as an expression, takes the tokens: items in order, optional ones may lack; runs within groups count as one."""
    flat = [(k, j, t) for k, (group, _, _) in enumerate(wrapper) for j, t in enumerate(group)]
    first = {k: at for at, (k, j, _) in enumerate(flat) if j == 0}

    def begins(k):
        """Places where an item may begin from item k on, and whether all of them may lack."""
        out = []
        while k < len(wrapper):
            out.append(first[k])
            if not wrapper[k][2]:
                return out, False
            k += 1
        return out, True

    after = []
    for k, j, _ in flat:
        group, repeated, _ = wrapper[k]
        if j + 1 < len(group):
            after.append((None, [len(after), len(after) + 1], False))
        else:
            again = ([first[k]] if repeated else []) + ([len(after)] if len(group) > 1 else [])
            after.append((k + 1, again, True))
    ahead = {}
    states, done = begins(0)
    for t in tokens:
        states, done, found = [], False, {s for s in states if flat[s][2] == t}
        for s in found:
            following, own, ends = after[s]
            states += own
            if ends:
                if following not in ahead:
                    ahead[following] = begins(following)
                states += ahead[following][0]
                done |= ahead[following][1]
        states = list(set(states))
    return done


def test_wrapper_takes_what_it_was_made_from():
    streams = ["nabbbf", "nabcbcbcf", "nf", "nxaf", "naf", "nabababf"]
    wrapper = html.infer([html.fold(list(s)) for s in streams])
    for s in streams:
        assert accepts(wrapper, s), (wrapper, s)
    assert not accepts(wrapper, "fn") and not accepts(wrapper, "nq") and not accepts(wrapper, "n")
    assert html.fold(list("bcbcbc")) == [(("b", "c"), True, False)]
    rng = random.Random(4)
    for _ in range(60):
        streams = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(5)]
        wrapper = html.infer([html.fold(list(s)) for s in streams])
        assert all(accepts(wrapper, s) for s in streams), (wrapper, streams)


def test_one_turn_of_a_group_is_the_group():
    for streams in (["ntptptpf", "ntpf", "ntptpf"], ["ntpf", "ntptpf", "ntppf"]):
        assert html.infer([html.fold(list(s)) for s in streams]) == [(("n",), False, False), (("t", "p"), True, False), (("f",), False, False)]


def test_alignment_by_halves():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 60))] for _ in range(2))
        whole, halves = html._common(a, b), html._common(a, b, 20)
        assert len(whole) == len(halves)
        for found in (whole, halves):
            assert all(a[i] == b[j] for i, j in found)
            assert all(x < y and z < w for (x, z), (y, w) in zip(found, found[1:], strict=False))


def kept(page):
    return html.main_text(html.blocks(page), frozenset(), frozenset())


def test_names_of_layouts_leave_the_article():
    own, other = "<p>one &amp; long enough</p><p>two</p>", "<div class=ad>Buy</div><div class='sidebar'><p>side</p></div>"
    for name in ("content sidebar-right", "sidebar-left", "container menu", "main widget-area"):
        for text in (f"<article>{own}</article>", f"<main>{own}</main>", f"<div>{own}</div>", own):
            page = f"<nav>menu</nav><div class='{name}'>{text}{other}</div>{other}"
            assert kept(page) == "one & long enough\n\ntwo", page
    assert kept(f"<div class=comments><main>{own}</main></div>") == "one & long enough\n\ntwo"
    # what is there beside an article, empty ones included, or is a menu, stays out
    for page in (
        "<article></article><div class=sidebar><p>side</p></div>",
        "<article></article><div class=sidebar><article>card</article></div>",
        "<div class=menu><ul><li><a href=/>a</a><li><a href=/>b</a></ul></div>",
        "<div class=ad><p>Buy</p></div>",
        "<div class=comments><article>first</article></div>",
        "<div class=cookie-notice>We use cookies</div><div class=newsletter>Mail</div>",
        "<div class=sidebar-right hidden><article>x</article></div>",
        "<aside><article>x</article></aside>",
    ):
        assert kept(page) == "", page
    assert kept("<div class=content><p>text</p></div><div class='menu'>much more plain text in a menu</div>") == "text\n\nmuch more plain text in a menu"


def test_dropped_within_a_line():
    for part in (
        "<button>Subscribe now</button>",
        "<svg><g><text>t</text></g></svg>",
        "<object><p>o</p></object>",
        "<canvas>c</canvas>",
        "<video><source src=x>no video</video>",
        "<div class='comment-body'>c</div>",
        "<div id=user-comments-section>c</div>",
        "<section class=reviews><article>r</article></section>",
    ):
        assert kept(f"<article><p>in</p>{part}<p>out</p></article>") == "in\n\nout", part
    for part in ("<span style='display: none'>h</span>", "<b hidden>h</b>", "<span class=ad>BUY<span>y</span> NOW</span>", "<a class=share href=/>s</a>", "<button>b</button>", "<i aria-hidden=true><i>x</i>y</i>"):
        assert kept(f"<article><p>in {part} out</p>{part}<p>end</p></article>") == "in out\n\nend", part
    assert kept("<article><p>in <span class=ad>BUY</p><p>end</p></article>") == "in\n\nend"  # unclosed


def test_no_rows(spark):
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_article_of_one_page_leaves_others_alone(spark):
    """A host with two templates, and pages without a host."""
    old, new = "<div id=content><p>old {}</p></div><nav>menu</nav>", "<div>site</div><article><p>new {}</p></article>"
    rows = [(k, None if k < 4 else "http://two.example/", (old if k % 2 else new).format(k)) for k in range(8)]
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: f"{'old' if k % 2 else 'new'} {k}" for k in range(8)}


def test_text_that_all_pages_share_is_template(spark):
    page = "<div class=tagline>best site</div><div id=content><h1>head {0}</h1><p>body {1}</p></div><div class=legal>all rights</div>"
    rows = [(k, "http://a.example/", page.format(k, k % 2)) for k in range(6)]
    rows += [(6, "http://a.example/", "<div class=tagline>best site</div><div class=legal>all rights</div>"), (7, "http://a.example/", "<article>own</article>")]
    rows += [(k, "http://copies.example/", page.format(1, 1)) for k in (8, 9)]
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert [got[k] for k in range(6)] == [f"head {k}\n\nbody {k % 2}" for k in range(6)]
    assert got[6] == "best site\n\nall rights" and got[7] == "own"  # nothing else is there
    assert got[8] == got[9] == "best site\n\nhead 1\n\nbody 1\n\nall rights"  # one page twice tells nothing


def unmarked(rng, k, style):
    """A page of a host without article or main, and its text by construction."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    head, parts = words(4), [words(rng.randint(8, 20)) for _ in range(rng.randint(3, 6))]
    cut = rng.randint(1, len(parts) - 1)
    body = [*parts[:cut], "* * *", *parts[cut:], "* * *", words(9)]
    menu = "".join(f"<div class=m{j}><a href=/{j}>{x}</a></div>" for j, x in enumerate(["Home", "News", "Sport"])) if style else "".join(f"<p><a href=/>{words(2)}</a></p>" for _ in range(3))
    notice = "<div>This site uses biscuits.</div>" if style else "<table><tr><td>Open</td><td>daily</td></tr></table>"
    single = words(3)
    page = f"<div class=top>Best &amp; only</div>{menu}<div class=c{k}><h1>{head}</h1>{''.join(f'<p>{x}</p>' for x in body)}</div><p><a href=/>{single}</a></p>{notice}<div class=legal>All rights reserved</div>"
    return page, "\n\n".join([head, *body, single])


def test_wrappers_of_unmarked_pages(spark):
    rng, rows, expected = random.Random(2), [], {}
    for k in range(60):
        page, text = unmarked(rng, k, k % 2)
        rows.append((k, f"http://u{k % 2}.example/{k}", page))
        expected[k] = text
    rows += [(100 + k, "http://u0.example/copy", rows[0][2]) for k in range(30)]  # copies tell nothing
    expected |= {100 + k: expected[0] for k in range(30)}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == expected
    # small parts, aligned in several rounds, come to the same
    own = html._pages(df)
    told = lambda found: {r["host"]: [set(x) for x in html.template(json.loads(r["wrapper"]))] for r in found.collect()}
    whole = told(html.wrappers(own))
    assert told(html.wrappers(own, size=2000)) == whole
    # a union of all tokens doesn't tell as much
    for r in html.wrappers(own).collect():
        tokens = sorted({t for g, _, _ in json.loads(r["wrapper"]) for t in g})
        assert [set(x) for x in html.template([((t,), False, True) for t in tokens])] != whole[r["host"]]


def test_names_that_hold_listed_words(spark):
    page = "<article><p class=share-price>price {0}</p><div class=related-work>work {0}</div><p>body {0}</p><div class='post-comments'>first</div><ul class=social-links><li>x</ul></article>"
    rows = [(k, "http://n.example/", page.format(k)) for k in range(3)]
    found = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: f"price {k}\n\nwork {k}\n\nbody {k}" for k in range(3)}


def test_hostile_pages_take_linear_time():
    n = 1 << 20
    pages = ["<a " * (n // 3), "<div>" * (n // 5), "<div>x" * (n // 6) + "</p>" * 1000, "<p>x<li>" * (n // 8), "<a '" * (n // 4 + 1) + ">", "<a '\">" * (n // 6), "<" * n, "<!--" * (n // 4), "</div" * (n // 5), "<script>" + "</scrip" * (n // 7), "&" * n, "<b>" * (n // 3), "<a href=x>y" * (n // 11)]
    for page in pages:
        began = time.process_time()
        found = html.blocks(page)
        html.fold([f"{b.path:x}" for b in found])
        assert time.process_time() - began < 20, page[:20]
    rng = random.Random(1)
    long_ = [html.fold([rng.choice("abcdefgh") for _ in range(6000)]) for _ in range(2)]
    assert html.infer(long_)
    streams = [[rng.choice("abcdefgh") for _ in range(800)] for _ in range(2)]
    wrapper = html.infer([html.fold(s) for s in streams])
    assert all(accepts(wrapper, s) for s in streams)
    assert [b.text for b in html.blocks("1 < 2 <b>& so</b> <a title='x > y'>on</a> <p>2 <![CDATA[no]]><? no ?></ p>&lt;p&gt;&nbsp;é<td>z")] == ["1 < 2 & so on", "2 <p> é", "z"]
