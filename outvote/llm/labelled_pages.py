"""Labelled pages that the extraction model learns from.

data-main="1" marks an element as content and "0" as not, with all below it that has no
mark of its own. {12} stands for twelve words of running text."""

from __future__ import annotations

import re

MARK = "data-main"

_FILL = (
    "the river rose after three days of rain and people along the lower road began to carry what they could to the school on the hill "
    "where the hall had been opened before dark with soup bread and a list of those who were still expected"
).split()


def _running_text(match: re.Match) -> str:
    n = int(match[1])
    words = [_FILL[(7 * n + i) % len(_FILL)] for i in range(n)]
    return " ".join(w.capitalize() + ("." if i % 11 == 10 or i == n - 1 else "") if i % 11 == 0 else w + "." * (i % 11 == 10 or i == n - 1) for i, w in enumerate(words))


_OUTLINES = (
    # a plain article between menu and footer
    """<nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav>
    <div class="ad">{9}</div>
    <article data-main="1"><h1>{6}</h1><p>{60}</p><p>{3}</p><p>{1}</p><p>{85}</p><p>{14}</p></article>
    <footer>&copy; Example &middot; {7}</footer>""",
    # an advert and a share bar inside the article
    """<header class="site-header"><div class="logo">Example</div><nav class="menu"><a href="/">Home</a> <a href="/x">World</a></nav></header>
    <main><article data-main="1"><h1>{8}</h1><p>{40}</p><div class="ad" data-main="0">{12}</div><p>{33}</p><h2>{4}</h2><p>{5}</p>
    <ul><li>{6}</li><li>{4}</li><li>{9}</li></ul><div class="share" data-main="0"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{51}</p></article>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">{5}</a></li><li><a href="/2">{6}</a></li></ul></aside></main>
    <footer><p>{10}</p><ul><li><a href="/imprint">Imprint</a></li></ul></footer>""",
    # divs only
    """<div id="header"><a href="/">{2}</a></div><div id="nav"><a href="/1">{1}</a> <a href="/2">{1}</a></div>
    <div id="wrapper"><div id="content" data-main="1"><h2>{5}</h2><p>{70}</p><blockquote><p>{20}</p></blockquote><p>{24}</p><p>{2}</p></div>
    <div id="sidebar"><h4>About</h4><p>{25}</p><ul><li><a href="/p">{3}</a></li></ul></div></div>
    <div id="comments"><h3>2 comments</h3><div class="comment"><p>{30}</p></div><div class="comment"><p>{8}</p></div></div>
    <div id="footer"><p>{9}</p></div>""",
    # comments as an ordered list, a form, a cookie notice
    """<div class="cookie-notice"><p>{18}</p><button>Accept</button></div><header><h1><a href="/">{2}</a></h1></header>
    <div class="post" data-main="1"><h1 class="entry-title">{7}</h1><div class="byline" data-main="0">By {2}</div>
    <div class="entry-content"><p>{44}</p><p>{62}</p><p>{8}</p></div><div class="tags" data-main="0"><a href="/t">{1}</a>, <a href="/u">{1}</a></div></div>
    <section class="comments"><h2>{2}</h2><ol><li class="comment"><p>{26}</p></li><li class="comment"><p>{45}</p></li></ol>
    <form id="respond"><p>Leave a reply</p><label>Name</label><input name="n"></form></section><footer><p>{6}</p></footer>""",
    # paragraphs right in the body
    """<h1 data-main="1">{5}</h1><p data-main="1">{30}</p><p data-main="1">{48}</p><p data-main="1">{4}</p><hr><div class="footer">{8}</div>""",
    # a table and a figure in the article, related links after it
    """<nav class="breadcrumb"><ol><li><a href="/">Home</a></li><li><a href="/s">{1}</a></li></ol></nav>
    <article class="story" data-main="1"><h1>{9}</h1><p>{36}</p><figure><figcaption>{11}</figcaption></figure>
    <table><tr><th>{1}</th><th>{1}</th></tr><tr><td>{2}</td><td>{1}</td></tr></table><p>{57}</p>
    <aside class="related" data-main="0"><h3>Related</h3><ul><li><a href="/r">{7}</a></li><li><a href="/q">{6}</a></li></ul></aside><p>{29}</p></article>
    <div class="newsletter"><p>{14}</p><form><input type="email"></form></div><footer>{5}</footer>""",
    # a section page: notices before and after
    """<div class="alert" role="alert"><p>{16}</p></div><div class="topbar"><a href="/login">Log in</a></div>
    <main class="main" data-main="1"><section><h1>{4}</h1><p>{90}</p></section><section><h2>{3}</h2><p>{22}</p><p>{2}</p><ol><li>{12}</li><li>{15}</li></ol></section>
    <div class="promo" data-main="0"><p>{10}</p></div></main>
    <div class="widget"><h4>{2}</h4><p>{13}</p></div><div class="copyright">{6}</div>""",
    # long adverts, short article
    """<div class="banner"><p>{40}</p></div><nav><a href="/">{1}</a></nav><article data-main="1"><h1>{3}</h1><p>{7}</p><p>{2}</p></article>
    <div class="sponsored"><p>{55}</p></div><div class="comments"><p>{60}</p><p>{12}</p></div><footer><p>{30}</p></footer>""",
    # a header of the article's own, links in the text
    """<header><nav><ul><li><a href="/">{1}</a></li><li><a href="/c">{1}</a></li></ul></nav></header>
    <article class="post" data-main="1"><h1>{6}</h1><p>{12} <a href="/l">{4}</a> {18}</p><p><a href="/m">{9}</a></p><p>{35} <a href="/n">{2}</a></p><pre>{16}</pre></article>
    <section id="disqus"><p>{21}</p></section><aside><p>{27}</p><p>{8}</p></aside><footer class="site-footer"><div>{4}</div><div>{12}</div></footer>""",
    # text right in divs
    """<div class="menu"><div><a href="/1">{1}</a></div><div><a href="/2">{2}</a></div></div><div class="body" data-main="1"><div>{42}</div><div>{18}</div><div>{3}</div></div>
    <div class="related-posts"><div><a href="/3">{6}</a></div></div><div class="search"><form>{2}</form></div><div class="footer">{11}</div>""",
    # paragraphs left open, a popup, a dialog
    """<div class="popup"><h3>{4}</h3><p>{17}</p></div><dialog><p>{9}</p></dialog><article data-main="1"><h1>{7}</h1><p><b>{28}<br><p>{64}</p><p><b>{2}<br><p>{31}</p></article>
    <div class="ad">{22}</div><footer>&copy; {2}</footer>""",
    # notes of the site above the article, a list of links below
    """<div class="notice">{20}</div><div id="main"><div class="article-body" data-main="1"><h2>{5}</h2><p>{52}</p><p>{6}</p><h3>{2}</h3><p>{75}</p></div>
    <ul class="pagination"><li><a href="?p=1">1</a></li><li><a href="?p=2">2</a></li></ul><div class="author"><p>{24}</p></div>
    <ul class="links"><li><a href="/e">{3}</a></li><li><a href="/f">{4}</a></li></ul></div><address>{5}</address>""",
    # two articles
    """<nav><ul><li><a href="/">{1}</a></li></ul></nav><main><article data-main="1"><h2>{4}</h2><p>{33}</p></article><article data-main="1"><h2>{3}</h2><p>{27}</p><p>{9}</p></article></main>
    <aside><div class="ad">{6}</div><div class="widget"><p>{18}</p></div></aside><footer><p>{7}</p></footer>""",
    # a comment section inside the article element
    """<header class="masthead"><p>{3}</p></header><article><div class="content" data-main="1"><h1>{5}</h1><p>{47}</p><p>{13}</p><p>{39}</p></div>
    <div class="comments"><h2>Comments</h2><article class="comment"><p>{34}</p></article><article class="comment"><p>{11}</p></article></div></article>
    <form class="login"><fieldset><legend>Log in</legend><p>{4}</p></fieldset></form><footer>{9}</footer>""",
    # a short article that holds a notice, a form and its comments
    """<nav>{2}</nav><aside class="notice"><p>{15}</p></aside><article data-main="1"><h2>{3}</h2><p>{14}</p><aside class="notice" data-main="0">{15}</aside>
    <form action="/s" data-main="0"><p>{12}</p></form><section class="comments" data-main="0"><article><p>{16}</p></article></section></article>""",
    """<article data-main="1"><h1>{5}</h1><div class="ad" data-main="0"><p>{11}</p></div><p>{8}</p><div class="share" data-main="0"><a href="/t">{1}</a></div>
    <p>{19}</p><div class="related" data-main="0"><ul><li><a href="/r">{4}</a></li></ul></div><footer data-main="0">{4}</footer></article><footer><p>{6}</p></footer>""",
    # wrappers in wrappers
    """<div><div><div><div><div data-main="1"><div><p>{24}</p><p>{2}</p></div><div><p>{38}</p></div></div></div></div></div></div><div class="footer"><div><div>{5}</div></div></div>""",
    """<div class="page"><div><div><div><div><div data-main="1">{45}</div></div></div></div></div></div>""",
    # text right in the body
    """<body data-main="1">{40}<br>{22}""",
    """<body data-main="1">{6}<p>{30}</p>{12}<p>{4}</p><div class="footer" data-main="0">{5}</div>""",
)

PAGES = tuple(f"<html>{re.sub(r'{(\d+)}', _running_text, outline)}</html>" for outline in _OUTLINES)
