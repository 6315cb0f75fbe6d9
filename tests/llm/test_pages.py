"""Pages written by hand, in the manner of common kinds of sites, against the text that a reader would call the article."""

from __future__ import annotations

import pytest

from kinloom.llm import html_main

BLOG = """<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Sourdough - Kitchen notes</title>
<link rel=stylesheet href=/s.css><script>window.x = "<p>hidden</p>";</script></head>
<body class="post-template-default single"><a class="skip-link" href="#content">Skip to content</a>
<header id=masthead class=site-header><div class=site-branding><a href=/ rel=home>Kitchen notes</a></div>
<nav class=main-navigation><ul><li><a href=/bread>Bread</a><li><a href=/soup>Soup</a></ul></nav></header>
<div id=content><main><article class="post type-post"><h1 class=entry-title>My first sourdough</h1>
<div class=entry-content><p>It's been two years since I baked my first loaf, and I still burn my fingers.
<p title=it's>The starter needs flour, water &amp; patience. Feed it twice a day, and keep it warm.</p>
<h2>What you need</h2><ul><li>500 g of strong flour<li>350 g of water</ul>
<blockquote><p>Bread is patience made edible, my grandmother said.</p></blockquote></div></article>
<div id=comments class=comments-area><h3>2 replies</h3><ol><li><p>Great recipe, thanks a lot for sharing it with all of us!</p></li></ol></div></main>
<aside id=secondary class=widget-area><section class=widget><h2>Recent posts</h2><ul><li><a href=/1>Rye</a></ul></section></aside></div>
<footer class=site-footer><p>&copy; 2020 Kitchen notes. All rights reserved.</p></footer></body></html>"""
BLOG_TEXT = (
    "My first sourdough It's been two years since I baked my first loaf, and I still burn my fingers. The starter needs flour, water & patience. "
    "Feed it twice a day, and keep it warm. What you need 500 g of strong flour 350 g of water Bread is patience made edible, my grandmother said."
)

NEWS = """<html><body><div class="cookie-banner">We use cookies to improve your experience. <a href=/p>Policy</a></div>
<div class="topbar"><ul><li><a href=/w>World</a></li><li><a href=/b>Business</a></li></ul></div>
<div class="page"><div class="story-body"><h1>River rises after three days of rain</h1>
<p>The river rose by two metres on Tuesday, officials said, and several roads were closed.</p>
<div class="ad-slot">Advertisement: buy a boat today.</div>
<p>Residents of the lower town were asked to move their cars. "We have seen worse," said a shopkeeper.</p>
<table><tr><th>Town</th><th>Level</th></tr><tr><td>Aven</td><td>3.2 m</td></tr></table>
<p>The water is expected to fall by the end of the week.</p></div>
<div class="sidebar related"><h3>Most read</h3><ul><li><a href=/1>Bridge closed</a></li></ul></div></div>
<div class="newsletter"><form action=/n><label>Mail</label><input name=m><button>Sign up</button></form></div>
<div class="footer"><a href=/i>Imprint</a> <a href=/c>Contact</a></div></body></html>"""
NEWS_TEXT = (
    "River rises after three days of rain The river rose by two metres on Tuesday, officials said, and several roads were closed. Residents of the "
    'lower town were asked to move their cars. "We have seen worse," said a shopkeeper. Town Level Aven 3.2 m The water is expected to fall by the end of the week.'
)


MANUAL = """<html><body><div id="wrapper"><div role="navigation" class="breadcrumbs"><a href=/>Docs</a> &gt; <a href=/i>Install</a></div>
<div role="main" class="document"><div class="section" id="install"><h1>Installing the tool</h1>
<p>Download the archive for your system and unpack it.</p><pre>tar xf tool.tar
make install</pre><p>Then run the checks, which take about a minute.</p>
<dl><dt>--fast</dt><dd>Leaves the slow checks out.</dd><dt>--quiet</dt><dd>Prints errors only.</dd></dl></div></div>
<div class="sphinxsidebar"><ul><li><a href=/a>Contents</a></li><li><a href=/b>Index</a></li></ul></div>
<div class="footer">Copyright 2021, the authors.</div></div></body></html>"""
MANUAL_TEXT = (
    "Installing the tool Download the archive for your system and unpack it. tar xf tool.tar make install Then run the checks, which take about a minute. "
    "--fast Leaves the slow checks out. --quiet Prints errors only."
)


@pytest.mark.parametrize(("page", "text"), [(BLOG, BLOG_TEXT), (NEWS, NEWS_TEXT), (MANUAL, MANUAL_TEXT)])
def test_articles(page, text):
    assert html_main.trained().text(page) == text


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<p title=it's>Quotes in bare values are letters, as they should be.", "Quotes in bare values are letters, as they should be."),
        ('<p class="x>An open quote swallows no text at all here.', "An open quote swallows no text at all here."),
        ("<p data-a='x>y' b>A mark within quotes ends no tag, of course.", "A mark within quotes ends no tag, of course."),
        ("<p>The formula <math>x=1</math> holds for all of them.", "The formula x=1 holds for all of them."),
        ("<p>Less < more, and a <3 b, said the page.", "Less < more, and a <3 b, said the page."),
        ("<p>One<!-- two --> three<!--> four, and so on it goes.", "One three four, and so on it goes."),
    ],
)
def test_markup_never_shows(inner, text):
    assert html_main.trained().text(f"<html><body><article><h1>Head line</h1>{inner}</article></body></html>") == f"Head line {text}"
