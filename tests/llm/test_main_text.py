from docsift.llm.main_text import extract_main_text, main_text

P = "A sentence that is long enough to count, with commas, and more words in it than a menu has."
ARTICLE = f"<h1>Title &amp; more</h1><p>{P}</p><p>Short.</p><p>{P} <a href=x>link</a>\n\n two</p>"
TEXT = f"Title & more\n\n{P}\n\nShort.\n\n{P} link two"
PAGE = f"""<!DOCTYPE html><html><head><title>no</title><style>p>{{}}</style><script>var t="</p>" + '<div>';</script></head><body>
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, as everyone does, and tell you so at length, again and again.</div>
<div class=ad>Buy now, cheap, cheap, cheaper than ever before, today only, here.</div>
{{}}
<aside>Related: {P}</aside><section id=comments><p>{P} says a reader, who goes on, and on.</p></section>
<form><input value=x><button>Send</button></form><footer>&copy; 2020 {P}</footer></body></html>"""


def page(body):
    return PAGE.replace("{}", body)


def test_containers():
    assert main_text(page(f"<article>{ARTICLE}</article>")) == TEXT
    assert main_text(page(f"<div id=content>{ARTICLE}</div>")) == TEXT
    assert main_text(page(f"<main><div><div>{ARTICLE}</div></div></main>")) == TEXT
    assert main_text(page(ARTICLE)) == TEXT
    assert main_text(page(f"<article class='has-sidebar'><header><h1>Head</h1></header><p>{P}</p><div class=share>Share this</div><footer>By me</footer></article>")) == f"Head\n\n{P}"


def test_siblings_are_kept():
    assert main_text(page(f"<div><h1>Head</h1><div>{ARTICLE}</div><p>{P} End.</p><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></div>")) == f"Head\n\n{TEXT}\n\n{P} End."


def test_broken_markup_and_references():
    assert main_text(f"<p><b>{P}<br><p>two &lt;b&gt; &#233;&#x41;&nbsp;&eacute;<p>three") == f"{P}\n\ntwo <b> éA é\n\nthree"
    assert main_text(f"<p>a < b, 1<2 and {P}<!-- <p>gone --><p>q</span></div>") == f"a < b, 1<2 and {P}\n\nq"
    assert main_text(f"<p title='a > b'>{P}</p><p id=\"x>y\">z</p><script>never closed <p>{P}") == f"{P}\n\nz"
    assert main_text("<p>unclosed <a href='x") == "unclosed"


def test_nothing_to_keep():
    for html in (None, "", " ", "<html></html>", "<nav>Menu</nav><footer>x</footer>", "<script>x</script>", page("")):
        assert main_text(html) == ""


def test_table(spark):
    rows = [(1, "u", page(ARTICLE), "x"), (2, None, None, None), (2, None, None, None), (None, "v", "<p>é</p>", ""), (3, "w", "<div>" * 3000 + f"<p>{P}", "")]
    schema = "page_id long, url string, html string, text string"
    found = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found) == sorted([(1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0), (0, "é", 1), (3, P, len(P))])
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_names_alone_lose_no_text():
    long = f"<h1>Title</h1>" + f"<p>{P}</p>" * 8
    want = "\n\n".join(["Title", *[P] * 8])
    for wrapper in ("class='site no-sidebar'", "id=wrapper class=header-fixed", "class='content sidebar-left'", "class=overlay", "class=has-comments"):
        assert main_text(page(f"<div {wrapper}>{long}</div>")) == want, wrapper
        assert main_text(page(f"<div {wrapper}><div class=post>{long}</div><div class=sidebar><p>{P}</p></div></div>")) == want, wrapper
    inside = f"<h2 id=related-work>Related work</h2><p>{P}</p><h2 id=login>Login</h2><p>{P}</p><section id=share-prices><h2>Prices</h2><p>{P}</p></section><section id=tags><p>{P}</p></section>"
    found = main_text(page(f"<article>{inside}<div class=related-posts><p>{P}</p></div><div id=tags>a, b</div><div class=share-on><a href=x>Share on X</a></div></article>"))
    assert found == "\n\n".join(["Related work", P, "Login", P, "Prices", P, P])
    assert main_text(page("".join(f"<div class=widget><p>{P} {k}</p></div>" for k in range(9)))).count(P) == 9
    assert main_text(f"<div class=comments>{long}</div>") == ""


def test_uneven_parts_of_one_article_are_kept():
    long, most = f"<p>{P}</p>" * 20, [P] * 20
    parts = [f"<header><h1>Head</h1></header>Loose line.<div class=lead><p>Lead, {P}</p></div><div class=content>{long}</div>Between.<section><p>{P * 4}</p></section><div><p>The end.</p></div>"]
    want = "\n\n".join(["Head", "Loose line.", f"Lead, {P}", *most, "Between.", P * 4, "The end."])
    for around in ("<article>{}</article>", "<main><div>{}</div></main>", "<div role=main>{}</div>", "<div role=main><div class=more>x</div><article>{}</article></div>", "<main><article class=content--comment>{}</article></main>"):
        found = main_text(page(around.format(*parts) + "<div class=more>Other, small.</div>"))
        assert found == want, around
    assert main_text(page(f"<div id=post><h1>Head</h1><div>{long}</div><div><p>{P}</p></div><div><p>The end.</p></div></div>")) == "\n\n".join(["Head", *most, P, "The end."])
    comments = f"<div id=comments><article class=comment><p>{P} I say.</p></article></div>"
    assert main_text(page(f"<main><div>{long}</div><div><p>Short end.</p></div>{comments}<nav>x</nav></main>")) == "\n\n".join([*most, "Short end."])
    assert main_text(page(f"<div><nav>x</nav><div>{long}</div><div>Small print.</div></div>")) == "\n\n".join(most)
