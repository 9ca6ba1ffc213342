"""Labelled pages that the page model is fitted to: ``data-main`` says which subtrees are main text."""

from __future__ import annotations

import random

from barweave.llm.html_graph import Model, Page, parse

# Page layouts. {S} a few words, {M} a sentence or two, {L} a paragraph, {N} a menu, {I} list items.
LAYOUTS = [
    '<html><head><title>{S}</title></head><body><nav>{N}</nav><div class="ad">{M}</div><article data-main="1"><h1>{S}</h1><p>{L}</p><p>{M}</p><p>{L}</p></article><footer>{M}</footer></body></html>',
    '<html><body><nav>{N}</nav><div class="ad">{L}</div><article data-main="1"><h1>{S}</h1><p>{S}</p></article><footer>{L}</footer></body></html>',
    '<html><body><header><div class="logo">{S}</div><nav>{N}</nav></header><main data-main="1"><h1>{S}</h1><p>{L}</p><h2>{S}</h2><ul>{I}</ul><p>{M}</p></main><aside><h3>{S}</h3><p>{M}</p><ul>{N}</ul></aside><footer><p>{M}</p></footer></body></html>',
    '<html><body><div id="header"><h1>{S}</h1><p>{M}</p></div><div id="content" data-main="1"><h2>{S}</h2><p>{L}</p><blockquote><p>{M}</p></blockquote><p>{L}</p></div><div id="sidebar"><h3>{S}</h3>{N}<p>{M}</p></div><div id="footer"><p>{M}</p></div></body></html>',
    '<html><body><div class="cookie-notice"><p>{L}</p><p>{S}</p></div><div class="page"><article data-main="1"><header><h1>{S}</h1></header><p>{L}</p><div class="share" data-main="0"><p>{S}</p>{N}</div><p>{L}</p></article><section class="comments"><h2>{S}</h2><article><p>{L}</p></article><div><p>{M}</p></div></section></div></body></html>',
    '<html><body><div class="alert notice">{M}</div><div class="wrap"><div class="post" data-main="1"><h1>{S}</h1><div class="entry"><p>{L}</p><div class="advert" data-main="0"><p>{L}</p></div><p>{M}</p><table><tr><td>{S}</td><td>{S}</td></tr></table></div></div><div id="comments"><ul><li><p>{L}</p></li><li>{M}</li></ul></div></div></body></html>',
    '<html><body><form class="search"><label>{S}</label><p>{M}</p></form><article data-main="1"><p>{L}</p><p>{S}</p><p>{L}</p><form class="newsletter" data-main="0"><p>{M}</p><label>{S}</label></form><pre>{L}</pre></article><form><p>{L}</p></form><footer><div>{M}</div><ul>{N}</ul></footer></body></html>',
    '<html><body><p data-main="1">{L}</p><p data-main="1">{L}</p><p data-main="1">{M}</p></body></html>',
    '<p data-main="1">{L}</p><p data-main="1">{M}</p>',
    '<html><body><div data-main="1"><p>{L}</p><p>{L}</p></div><div class="footer">{M}</div></body></html>',
    '<html><body><ul class="menu">{N}</ul><h1 data-main="1">{S}</h1><p data-main="1">{L}</p><p data-main="1">{L}</p><div class="related">{N}</div><p class="copyright">{M}</p></body></html>',
    '<html><body><header><h1>{S}</h1><p>{L}</p></header><section><article data-main="1"><h2>{S}</h2><p>{M}</p><figure><figcaption>{M}</figcaption></figure><ol>{I}</ol><p>{L}</p></article></section><aside>{L}</aside><aside class="sidebar"><p>{L}</p></aside></body></html>',
    '<html><body><nav><ul>{N}</ul></nav><main data-main="1"><article><h1>{S}</h1><p>{L}</p><aside data-main="0"><p>{L}</p></aside><nav data-main="0">{N}</nav><footer data-main="0"><p>{M}</p></footer></article></main><div class="sponsored">{L}</div><div class="modal popup">{M}</div></body></html>',
    '<html><body><div class="banner promo"><p>{L}</p></div><div class="content" data-main="1"><p>{M}</p><h3>{S}</h3><dl>{I}</dl><p>{L}</p></div><div class="comment-list"><div class="comment"><p>{L}</p></div><div class="comment"><p>{M}</p></div></div><div class="sidebar widget"><p>{L}</p></div></body></html>',
    '<html><body><nav>{N}</nav><article data-main="1"><p>{S}</p></article><aside><p>{L}</p></aside><footer>{S}</footer></body></html>',
    '<html><body><div role="navigation">{N}</div><div role="main" data-main="1"><p>{L}</p><p>{L}</p><div><p>{M}</p></div></div><div role="complementary" class="side"><p>{L}</p></div><div class="newsletter subscribe"><p>{M}</p></div></body></html>',
]
_WORDS = "alder brook cairn dune ember fjord glade heath inlet knoll ledge marsh north orchard pasture quarry ridge slope tarn upland vale willow".split()


def _fill(layout: str, rng: random.Random) -> str:
    words = lambda a, b: " ".join(rng.choice(_WORDS) for _ in range(rng.randint(a, b)))
    end = lambda: rng.choice([".", ".", ".", "", "!", "?"])
    out = layout
    for mark, make in (
        ("{S}", lambda: words(1, 6) + rng.choice(["", "", "."])), ("{M}", lambda: words(6, 25) + end()), ("{L}", lambda: words(*rng.choice([(4, 20), (20, 60), (60, 300)])) + end()),
        ("{N}", lambda: "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(rng.randint(2, 8))) + "</ul>"), ("{I}", lambda: "".join(f"<li>{words(3, 20)}{end()}</li>" for _ in range(rng.randint(2, 5)))),
    ):
        while mark in out:
            out = out.replace(mark, make(), 1)
    return out


def labelled_pages(copies: int = 4, seed: int = 7) -> list[Page]:
    rng = random.Random(seed)
    return [parse(_fill(layout, rng)) for layout in LAYOUTS for _ in range(copies)]


def fitted(copies: int = 6, rounds: int = 300, seed: int = 7) -> Model:
    """The page model, fitted to ``copies`` fillings of each layout; the same for the same arguments."""
    return Model().fit(labelled_pages(copies, seed), rounds)
