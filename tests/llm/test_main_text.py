import html
import random
import time

import pytest

from tracelode.llm import main_text as m

ONE = "The council met on Tuesday, and after four hours of debate, it voted to approve the plan."
TWO = "Residents said they were pleased; others, however, were not so sure: “we will see”."
THREE = "Short one."
BODY = "".join(f"<p>{p}</p>" for p in (ONE, TWO, THREE))
LONG_COMMENT = "<p>First! I really think, that this is bad, bad, bad. Truly, a long comment, with more text in it than the article has, and more, and more.</p>"
PAGES = {
    "everything around": (
        "<html><head><title>T</title></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class='cookie-notice'><p>We use cookies, and so on. Accept them, please.</p></div>"
        f"<main><article><header><h1>Title here</h1><p class=byline>By A</p></header>{BODY}<ul><li>One point</li><li>Two point</li></ul><blockquote><p>Quote it.</p></blockquote><div class='ad'>Buy now!</div>"
        f"<aside>Related</aside></article><section id='comments'><h2>Comments</h2><div class='comment'>{LONG_COMMENT}</div></section></main><aside class=sidebar><p>Popular posts</p></aside>"
        "<form><label>Name</label><input><button>Send</button></form><footer>&copy; 2020</footer></body></html>",
        ["Title here", ONE, TWO, THREE, "One point", "Two point", "Quote it."],
    ),
    "only names tell": (
        f"<body><div id=header><a href=/>Home</a></div><div id=nav><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div><div id=content><h1>Title here</h1>{BODY}</div><div id=sidebar><ul><li><a>foo</a></li></ul></div>"
        "<div id=footer>Copyright 2020. All rights.</div></body>",
        ["Title here", ONE, TWO, THREE],
    ),
    "nothing tells": (f"<body><div class=x1>Buy shoes now.</div><div class=story><h2>Title here</h2>{BODY}</div><div class=x3><p>Great post!</p></div></body>", ["Title here", ONE, TWO, THREE]),
    "paragraphs of the body": (f"<body><h1>Title</h1>{BODY}</body>", ["Title", ONE, TWO, THREE]),
    "no element": ("Just some text &lt;b&gt; &#8364; &#x41;&nbsp;&amp b", ["Just some text <b> € A & b"]),
    "table layout": (f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td>{BODY}</td></tr></table>", [ONE, TWO, THREE]),
    "a box around the article": (f"<body class='has-sidebar'><div class='content-with-sidebar'><div class=entry>{BODY}</div></div></body>", [ONE, TWO, THREE]),
    "line breaks": ("<body><div class=post>Line one is here, and it is long.<br>Still one.<br><br>Second block, also a longer one.</div></body>", ["Line one is here, and it is long. Still one.", "Second block, also a longer one."]),
    "links in it": (f"<article>{BODY}<p><a href=1>Wholly a link</a></p><ul><li><a>Tag1</a></li></ul></article>", [ONE, TWO, THREE, "Wholly a link"]),
    "two containers": (f"<div class='sec-1'><p>{ONE}</p><p>{TWO}</p></div><div class='sec-2'><h3>Head</h3><p>{THREE}</p></div>", [ONE, TWO, "Head", THREE]),
    "figure, pre, table": (f"<article><h1>T</h1>{BODY}<figure><img><figcaption>Cap</figcaption></figure><pre>a  b\n c</pre><table><tr><td>c1<td>c2</table></article>", ["T", ONE, TWO, THREE, "Cap", "a b c", "c1", "c2"]),
    "comments as articles": (f"<article><h1>T</h1>{BODY}<article>{LONG_COMMENT}</article></article><ol class=commentlist><li><article class=comment>{LONG_COMMENT}</article></li></ol>", ["T", ONE, TWO, THREE]),
    "short article": ("<nav>x</nav><article><h1>T</h1><p>Hi.</p></article><footer>foo bar foo, bar foo.</footer>", ["T", "Hi."]),
    "scripts and styles": ("<script>document.write('<p>no</p>')</script><article><p>Yes, it is.</p><SCRIPT>x</script ><style>p{}</style><noscript>no</noscript><!-- <p>no</p> --></article>", ["Yes, it is."]),
    "hidden": ("<article><p>Yes, it is.</p><p hidden>no</p><p style='display: none'>no</p><div aria-hidden='true'>no</div></article>", ["Yes, it is."]),
    "signs in attributes and text": ("<article><p title='a > b'>Yes, 3 <4 and a < b.</p><p data-x=\"<p>\">Two.</p></article>", ["Yes, 3 <4 and a < b.", "Two."]),
    "unclosed": ("<article><p><b>Yes, it is.<br><p>Two.<ul><li>a<li>b</ul><p cla", ["Yes, it is.", "Two.", "a", "b"]),
    "nothing": ("", []),
    "only around": ("<nav>Home</nav><footer>End.</footer>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    source, wanted = PAGES[name]
    assert m.main_text_of(source) == "\n".join(wanted)


def test_random_pages_come_back_whole():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdé&<\"'", k=rng.randrange(1, 9)))
    say = lambda n: html.escape(" ".join(word() for _ in range(n)).replace("<", "≤") + ".")
    for _ in range(60):
        blocks = [say(rng.randrange(1, 80)) for _ in range(rng.randrange(1, 12))]
        inner = "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<p>\n {}", "<blockquote><p>{}</p></blockquote>", "<div>{}</div>", "<ul><li>{}</li></ul>"]).format(b.replace(" ", rng.choice([" ", "\n\t", " <i>", "</b> "]))) for b in blocks)
        around = "".join(f"<{t}>{say(9)}</{t}>" for t in rng.sample(["nav", "aside", "footer", "form", "header"], 3))
        source = f"<html><body>{around}<article>{inner}</article><div class='comments'>{LONG_COMMENT}</div></body></html>"
        assert m.main_text_of(source) == "\n".join(" ".join(html.unescape(b).split()) for b in blocks)


def test_any_text_is_read_in_linear_time():
    rng = random.Random(5)
    pieces = ["<p>", "</p>", "<div class='ad", "'", '"', "<", ">", "</", "&am", "&#x", "<!--", "-->", "<script>", "</script>", "<article>", "</article>", "<li>", "<td>", "<a href=", " text, more. ", "\x00", "<br/>", "<!x", "</ul>"]
    for _ in range(500):
        assert isinstance(m.main_text_of("".join(rng.choices(pieces, k=rng.randrange(40)))), str)
    began = time.time()
    deep = m.main_text_of("<div>" * 30_000 + ONE + "</div>" * 30_000)
    long = m.main_text_of("<article>" + f"<p>{ONE}</p>" * 50_000 + "</article>")
    assert deep == ONE and long.count("\n") == 49_999 and time.time() - began < 30


def test_rows(spark):
    rows = [(1, "u", None, 5, "k"), (2, None, PAGES["short article"][0], None, "k"), (2, None, PAGES["short article"][0], 7, "k"), (None, "v", "<p>Only, one.</p>", 1, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = m.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted([(1, "u", "", 0), (2, None, "T\nHi.", 5), (2, None, "T\nHi.", 5), (None, "v", "Only, one.", 10)], key=repr)
    assert m.main_text(pages.limit(0)).count() == 0 and m.blocks(pages.limit(0)).count() == 0
    kept = m.blocks(pages.where("page_id = 2").limit(1)).where("kept").sort("block").collect()
    assert [(r.path, r.text) for r in kept] == [("article/h1", "T"), ("article/p", "Hi.")]
