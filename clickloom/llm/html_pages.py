"""Labelled pages for the model of main text: made from a rule, marked by `data-keep`.

`data-keep="1"` marks what belongs to the main text, `"0"` what does not; a mark
holds for all inside it that has no mark of its own.
"""

from __future__ import annotations

WORDS = (
    "the old mill stands near a quiet river and people from many towns come to see how "
    "grain was ground there before engines took over most of that work"
).split()

#: Places of the main text, and what is in it.
HOLDERS = [
    ("article", ""),
    ("main", ""),
    ("div", 'class="content"'),
    ("div", 'id="main-content"'),
    ("section", 'class="post-body"'),
    ("div", 'class="entry text"'),
    ("div", 'class="article-body story"'),
    ("main", 'role="main"'),
    ("div", 'id="main"'),
    ("div", ""),
    ("", ""),
]

#: Parts that are not main text: element, attributes, and what they hold.
OTHERS = [
    ("nav", "", "menu"),
    ("div", 'class="menu navbar"', "menu"),
    ("ul", 'class="nav navigation"', "menu"),
    ("div", 'role="navigation"', "menu"),
    ("div", 'class="breadcrumb breadcrumbs"', "menu"),
    ("div", 'class="pagination pager"', "menu"),
    ("div", 'class="toc-links menu"', "menu"),
    ("header", "", "brand"),
    ("div", 'class="header masthead"', "brand"),
    ("div", 'id="top-header" role="banner"', "brand"),
    ("div", 'class="logo brand header"', "brand"),
    ("footer", "", "legal"),
    ("div", 'class="footer copyright"', "legal"),
    ("div", 'id="footer" role="contentinfo"', "legal"),
    ("aside", "", "teasers"),
    ("div", 'class="sidebar widget"', "teasers"),
    ("div", 'id="sidebar" role="complementary"', "teasers"),
    ("div", 'class="related recommended"', "teasers"),
    ("section", 'class="related-posts teaser"', "teasers"),
    ("div", 'class="ad"', "line"),
    ("div", 'class="ads advert"', "line"),
    ("div", 'class="advertisement sponsored"', "lines"),
    ("div", 'class="promo sponsor"', "lines"),
    ("section", 'class="ad banner"', "lines"),
    ("aside", 'class="ad advert promo"', "line"),
    ("p", 'class="ad sponsored"', "bare"),
    ("div", 'class="notice"', "line"),
    ("div", 'class="cookie-notice consent"', "buttons"),
    ("div", 'id="cookie-banner" role="dialog"', "buttons"),
    ("div", 'class="alert warning notice" role="alert"', "line"),
    ("p", 'class="notice disclaimer"', "bare"),
    ("section", 'class="notice gdpr privacy"', "lines"),
    ("form", "", "fields"),
    ("form", 'class="search" role="search"', "fields"),
    ("form", 'class="newsletter subscribe signup"', "fields"),
    ("div", 'class="newsletter subscribe"', "fields"),
    ("div", 'class="login form"', "fields"),
    ("div", 'class="share social sharing"', "menu"),
    ("div", 'class="popup modal overlay"', "buttons"),
    ("section", 'class="comments"', "comments"),
    ("div", 'id="comments"', "comments"),
    ("ol", 'class="comment-list comments"', "replies"),
    ("div", 'class="comment reader-comments responses"', "comments"),
    ("div", 'class="discussion replies comment"', "comments"),
    ("aside", 'class="sidebar"', "lines"),
    ("div", 'class="aside sidebar rail"', "lines"),
    ("div", 'class="side bar"', "teasers"),
    ("div", 'class="main menu top bar"', "menu"),
    ("div", 'class="legal terms disclaimer"', "legal"),
    ("div", 'class="recommendations suggested"', "teasers"),
    ("div", 'class="tag cloud tagcloud tags"', "menu"),
    ("footer", "", "menu"),
    ("footer", "", "lines"),
    ("header", "", "menu"),
    ("header", "", "bare"),
    ("nav", "", "lines"),
    ("aside", "", "menu"),
    ("aside", "", "bare"),
    ("form", "", "menu"),
    ("form", "", "bare"),
]

#: Pages for each of OTHERS, with other texts, neighbours and places.
ROUNDS = 8


def _text(n: int, seed: int) -> str:
    words = [WORDS[(seed * 7 + k * (1 + seed % 5)) % len(WORDS)] for k in range(n)]
    return " ".join(words).capitalize() + "."


def _links(n: int, seed: int) -> str:
    """Items of a menu; every third menu is without links."""
    words = [_text(1 + (seed + k) % 3, seed + k) for k in range(n)]
    if seed % 3 == 0:
        return "".join(f"<li>{w}</li>" for w in words)
    return "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(words))


def _other(part: tuple[str, str, str], seed: int) -> str:
    """A part that is not main text."""
    tag, marks, holds = part
    h = "h2" if seed % 5 == 0 else f"h{3 + seed % 2}"
    inside = {
        "menu": f"<ul>{_links(4, seed)}</ul>" if tag != "ul" else _links(4, seed),
        "brand": f'<a href="/">{_text(2, seed)}</a><p>{_text(5, seed)}</p><ul>{_links(3, seed)}</ul>',
        "legal": f'&copy; {_text(4, seed)} <p>{_text(12, seed)}</p><a href="/t">{_text(2, seed)}</a>',
        "teasers": f"<{h}>{_text(2, seed)}</{h}><ul>{_links(5, seed)}</ul><p>{_text(14, seed)}</p>",
        "line": _text(9 + seed % 12, seed),
        "lines": f"<{h}>{_text(3, seed)}</{h}><p>{_text(18, seed)}</p><p>{_text(30, seed)}</p>",
        "bare": _text(14, seed),
        "buttons": f"<p>{_text(22, seed)}</p><button>{_text(1, seed)}</button>",
        "fields": f"<label>{_text(3, seed)}</label><input name=q><p>{_text(8, seed)}</p>"
        f"<div>{_text(4, seed)}</div><button>{_text(1, seed)}</button>",
        "comments": f"<{h}>{_text(1 + seed % 2, seed)}</{h}><div class='comment'><b>{_text(1, seed)}</b>"
        f"<p>{_text(25, seed)}</p></div><div class='comment reply'><p>{_text(40, seed)}</p></div>",
        "replies": f"<li><p>{_text(30, seed)}</p></li><li><p>{_text(12, seed)}</p></li>",
    }[holds]
    return f'<{tag} {marks} data-keep="0">{inside}</{tag}>'


def _content(seed: int) -> list[str]:
    """Pieces of main text."""
    return [
        f"<h1>{_text(5 + seed % 4, seed)}</h1>",
        f"<p>{_text(30 + seed % 50, seed)}</p>",
        f"<p><b>{_text(3 + seed % 9, seed)}<br><p>{_text(60 + seed % 70, seed)}</p>",
        f'<h2>{_text(3, seed)}</h2><p>{_text(12, seed)} <a href="/x">{_text(2, seed)}</a> {_text(20, seed)}</p>',
        f"<ul><li>{_text(4 + seed % 9, seed)}</li><li>{_text(12, seed)}</li></ul>",
        f"<blockquote><p>{_text(22, seed)}</p></blockquote><p>{_text(1 + seed % 3, seed)}</p>",
        f"<table><tr><th>{_text(1, seed)}</th><td>{_text(2, seed)}</td></tr></table>",
        f"<figure><img src=a><figcaption>{_text(8, seed)}</figcaption></figure>",
        f"<pre>{_text(11, seed)}</pre><ol><li>{_text(15, seed)}</li></ol><h3>{_text(4, seed)}</h3>",
        f"<div>{_text(25, seed)}</div><section><h2>{_text(3, seed)}</h2><p>{_text(40, seed)}</p></section>",
        "".join(f"<p>{_text(1 + j % 4, seed + j)}</p>" for j in range(9)),
        "".join(f"<p><b>{_text(1 + j % 3, seed + j)}<br><p>{_text(2 + j, seed + j)}</p>" for j in range(7)),
        "<ul>" + "".join(f"<li>{_text(1 + j % 5, seed + j)}</li>" for j in range(6)) + "</ul>",
        f"<dl><dt>{_text(2, seed)}</dt><dd>{_text(9, seed)}</dd></dl><p>{_text(90, seed)}</p>",
        f'<p>{_text(14, seed)}</p><ul><li><a href="/x">{_text(4 + seed % 6, seed)}</a></li><li>{_text(2, seed)}</li></ul>',
        f"<p>{_text(16 + seed % 9, seed)}</p><p>{_text(2, seed)}</p><p>{_text(19, seed)}</p>",
        f"<div>{_text(18 + seed % 20, seed)}</div><div>{_text(70, seed)}</div>",
    ]


#: Parts that an article has of its own and that are no main text.
INNER = [
    ("header", "", "bare"),
    ("aside", 'class="pullquote"', "bare"),
    ("footer", "", "bare"),
    ("nav", 'class="toc"', "menu"),
    ("aside", "", "teasers"),
    ("footer", 'class="meta"', "menu"),
    ("header", "", "brand"),
    ("form", 'class="newsletter"', "fields"),
]


def _with_inner(pieces: list[str], seed: int) -> list[str]:
    """Pieces of main text among which two to five other parts stand."""
    out = list(pieces)
    for j in range(2 + seed % 4):
        part = INNER[(seed + 3 * j) % len(INNER)]
        place = {"header": 0, "footer": len(out)}.get(part[0], 1 + (seed + j) % len(out))
        out.insert(place, _other(part, seed + j))
    return out


def labelled_pages() -> list[str]:
    """Pages for each other part, with holders in turn, and parts around and inside."""
    pages = []
    for k, part in enumerate(OTHERS * ROUNDS):
        tag, marks = HOLDERS[k % len(HOLDERS)]
        content = _content(k)
        pieces = [content[0], *(content[1 + (k * 3 + j) % (len(content) - 1)] for j in range(6))]
        lists = ["".join(f"<li>{_text(1 + (k + j) % 9, k + j)}</li>" for j in range(3 + k % 8))] * 2
        pieces.insert(1 + k % 5, f"<ul>{lists[0]}</ul><p>{_text(20, k)}</p><ol>{lists[1]}</ol>")
        around = [_other(OTHERS[(k * 5 + j * 11) % len(OTHERS)], k + j) for j in range(5)]
        if k // len(OTHERS) % 2 == 0:
            around.insert(k % 4, _other(part, k))
        else:
            pieces.insert(2 + k % 4, _other(part, k))
        kind = ("p", "p", "div")[k % 3]  # an article is mostly paragraphs
        for j in range(8):
            pieces.append(f"<{kind}>{_text(15 + (k * 5 + j * 9) % 45, k + j)}</{kind}>")
        if k % 5 == 3:  # a short article
            pieces = [*pieces[:1], f"<p>{_text(18 + k % 12, k)}</p>", f"<p>{_text(21 + k % 30, k)}</p>"][k % 2 :]
        if k % 2:
            pieces = _with_inner(pieces, k)
        held = "".join(pieces)
        if tag:
            held = f'<{tag} {marks} data-keep="1">{held}</{tag}>'
        if k % 3 == 1:
            held = f'<div class="wrapper container">{held}</div>'
        body = "".join([*around[:3], held, *around[3:]])
        if k % 4 == 2:  # a frame around all
            body = f'<div class="page wrapper">{body}</div>'
        pages.append(
            f"<!DOCTYPE html><html><head><title data-keep='0'>{_text(4, k)}</title></head><body>{body}</body></html>"
        )
    return pages
