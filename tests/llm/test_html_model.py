import itertools
import random

import pytest

from clickloom.llm import html_model as h
from clickloom.llm.html_pages import labelled_pages

PAGES = "page_id long, url string, html string, text int, n_chars string"


@pytest.fixture(scope="module")
def model():
    return h.TreeModel(labelled_pages())


def brute_marginals(model, nodes):
    """Sums over all states of all nodes."""
    own = []
    for things in h.features(nodes):
        own.append(model.potential(things))
    total, ones = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes) - 1):
        states = (1, *states)
        weight = 1.0
        for k in range(1, len(nodes)):
            pair = model.pair[h._kind(nodes[nodes[k].parent], nodes[k])]
            weight *= own[k][states[k]] * pair[states[nodes[k].parent]][states[k]]
        total += weight
        for k, s in enumerate(states):
            ones[k] += weight * s
    return [x / total for x in ones]


def test_messages_give_the_exact_marginals(model):
    draw = random.Random(3)
    for _ in range(20):
        tags = ["div", "p", "nav", "article", "ul", "li", "footer", "form"]
        page = ""
        for _ in range(draw.randrange(1, 9)):
            page += draw.choice([f"<{draw.choice(tags)}>", "</div>", "some words here ", '<div class="ad">'])
        nodes, _ = h.parse(page)
        if len(nodes) <= 12:
            assert brute_marginals(model, nodes) == pytest.approx(model.marginals(nodes))


def test_held_out_pages(model):
    """A model trained on every other labelled page judges the rest."""
    pages = labelled_pages()
    half = h.TreeModel(pages[::2])
    right = total = 0
    for page in pages[1::2]:
        nodes, blocks = h.parse(page)
        belief, state = half.marginals(nodes), []
        for node in nodes:
            up = state[node.parent] if node.parent >= 0 else 1
            state.append(up if node.keep is None else int(node.keep))
        for k, _ in blocks:
            if not nodes[k].hidden:
                total += 1
                right += (belief[k] > 0.5) == bool(state[k])
    assert right >= 0.97 * total


ARTICLE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- <p>no</p> -->"
    '<div class="ad">Buy these shoes now.</div><article><h1>A &lt;b&gt; &amp; more</h1>'
    "<p><b>Bold\n  words.<br><p>Second  <a href=x>paragraph</a>&nbsp;of the text, which is long.</p>"
    '<div class="comments"><p>I agree with every word of it.</p></div></article>'
    '<aside class="sidebar"><p>Most read today</p></aside><form><p>Sign up</p><input></form>'
    '<div class="cookie-notice"><p>We use cookies on this site.</p></div><footer>&copy; 2024</footer>'
)
MAIN = "A <b> & more\n\nBold words.\n\nSecond paragraph of the text, which is long."


def test_pages(spark):
    rows = [
        (1, "u", ARTICLE),
        (2, None, None),
        (3, "u", ""),
        (4, "u", "plain text only"),
        (1, "u", ARTICLE),
        (None, "u", "<nav><a href=x>menu</a></nav>"),
        (5, "u", "<article>" + "<p>word word word and more</p>" * 5000 + "</article>"),
        (6, "u", "<p>open <div <<< & &#x110000; </p></p></article></nav>"),
        (7, "u", "<div>" * 2000 + "deep down there is some text</div>"),
    ]
    got = h.extract(spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == [MAIN, MAIN]
    assert text[2] == text[3] == text[None] == ""
    assert text[4] == "plain text only"
    assert text[5].count("\n\n") == 4999
    assert isinstance(text[6], str) and isinstance(text[7], str)


@pytest.mark.parametrize("piece", ["<a", "<a ", "<!--", "<p x=\"", "</", "<div>", "<" + "b" * 100])
def test_long_broken_pages_take_linear_time(model, piece):
    assert isinstance(h.main_text(piece * 30_000, model), str)


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
        ("a<br>b<i>c</i> d", ["a bc d"]),
        ("<p title='a>b'>x</p><textarea><p>no</textarea>", ["x"]),
        ("<p>a<!-- open comment", ["a"]),
        ("<script>never closed", []),
    ],
)
def test_blocks(page, blocks):
    assert [t for _, t in h.parse(page)[1]] == blocks

# Frames written by hand, not by the generator of the labelled pages.
P = 'The mill by the river was built long before the town had a bridge, and its wheel still turns on market days.'
Q = 'Visitors come from far away to see how grain was ground by hand and by water, and many of them stay until evening.'
R = 'In winter the mill is closed, but the keeper opens the yard for schools and for anyone who writes a letter in time.'
S = 'Short line.'
FRAMES = {
    'hdr aside foot': (
        f'<body><article><header><h1>Title</h1></header><p>{P}</p><aside class=pullquote>Grain was ground by hand</aside><footer>Filed under history</footer></article></body>',
        ['Title', P],
    ),
    'byline two': (
        f'<body><article><header><h1>Old Mill</h1><p class=byline>By Ann Lee</p></header><p>{P}</p><p>{Q}</p><footer>Tags</footer></article></body>',
        ['Old Mill', P, Q],
    ),
    'mixed class': (
        f"<body><article class='post comment-free no-sidebar has-ads'><h1>Old Mill</h1><p>{P}</p></article></body>",
        ['Old Mill', P],
    ),
    'notice id': (
        f"<body><article id='notice-about-privacy'><h1>Old Mill</h1><p>{P}</p></article></body>",
        ['Old Mill', P],
    ),
    'nested comments': (
        f'<body><main><h1>T</h1><p>{P}</p><p>{Q}</p><section class=comments><h2>Comments</h2><div class=comment><p>{R}</p></div></section></main></body>',
        ['T', P, Q],
    ),
    'form inside': (
        f'<body><article><h1>T</h1><p>{P}</p><form class=newsletter><label>Mail</label><p>Get our letter every week</p><button>Go</button></form><p>{Q}</p></article></body>',
        ['T', P, Q],
    ),
    'all inside': (
        f'<body><div class=page><header><a href=/>Site</a><nav><a href=/a>A</a></nav></header><article><header><h1>T</h1></header><nav class=toc><a href=#a>a</a><a href=#b>b</a></nav><p>{P}</p><aside><h4>More</h4><a href=/m>m</a></aside><p>{Q}</p><form><input><p>Search here</p></form><footer>By A</footer></article><footer>Copyright</footer></div></body>',
        ['T', P, Q],
    ),
    'only p': (
        f'<body><p>{P}</p><p>{Q}</p></body>',
        [P, Q],
    ),
    'sidebar last': (
        f'<body><main><article><h1>T</h1><p>{P}</p><p>{Q}</p><p>{R}</p></article></main><aside class="sidebar"><h3>More</h3><p>{S}</p><ul><li><a href=/1>One</a></li></ul></aside></body>',
        ['T', P, Q, R],
    ),
    'cookie': (
        f'<body><div class="cookie-banner">{R}<button>OK</button></div><article><p>{P}</p><p>{Q}</p></article></body>',
        [P, Q],
    ),
    'figure': (
        f'<body><article><h1>T</h1><figure><img src=a><figcaption>The wheel</figcaption></figure><p>{P}</p><blockquote>{Q}</blockquote></article></body>',
        ['T', 'The wheel', P, Q],
    ),
    'short paras': (
        f'<body><header>Site</header><article><h1>T</h1><p>{S}</p><p>{P}</p><p>{S}</p></article></body>',
        ['T', S, P, S],
    ),
    'related': (
        f'<body><article><h1>T</h1><p>{P}</p><p>{Q}</p><div class="related-posts"><h3>Related</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div></article></body>',
        ['T', P, Q],
    ),
    'share': (
        f'<body><article class="entry single-post"><h1>T</h1><div class="social share"><a href=/t>Tweet</a></div><p>{P}</p><p>{Q}</p></article></body>',
        ['T', P, Q],
    ),
}


@pytest.mark.parametrize("name", FRAMES)
def test_frames(name):
    page, expected = FRAMES[name]
    model = h.TreeModel(h.labelled_pages())
    assert h.main_text(f"<!DOCTYPE html><html>{page}</html>", model) == "\n\n".join(expected)
