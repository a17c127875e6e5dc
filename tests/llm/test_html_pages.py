"""Pages of many shapes, each block labelled by hand: those that begin with "Art" are the article's, "Off" is everything else."""

import re

import pytest

from wordloom.llm import html

WORDS = "tells in some detail what was found by the river, who saw it first and why they all agree on that today."


class Page:
    """Numbers its blocks, so that all are different."""

    def __init__(self):
        self.n = 0

    def a(self, words=WORDS):
        self.n += 1
        return f"Art {self.n} {words}"

    def o(self, words=WORDS):
        self.n += 1
        return f"Off {self.n} {words}"

    def ps(self, n, tag="p"):
        return "".join(f"<{tag}>{self.a()}</{tag}>" for _ in range(n))

    def menu(self, n=5):
        return "<ul>" + "".join(f"<li><a href=/{k}>{self.o('page')}</a></li>" for k in range(n)) + "</ul>"


SHAPES = {
    "sections": lambda p: f"<nav>{p.menu()}</nav><article><header><h1>{p.a('title')}</h1><p>{p.a('by A. Writer')}</p></header><section>{p.ps(4)}</section><section><h2>{p.a('two')}</h2><p>{p.a('short note.')}</p></section><section>{p.ps(2)}</section></article><footer>{p.o()}</footer>",
    "slug ids": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(2)}<h2 id='cookies'>{p.a('on cookies')}</h2>{p.ps(1)}<h2 id='comments-on-the-bill'>{p.a('comments on the bill')}</h2>{p.ps(1)}</article><aside>{p.o()}</aside>",
    "newsletter section": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(2)}<section id='newsletter'><h2>{p.a('the newsletter')}</h2>{p.ps(4)}</section></article>",
    "inline words": lambda p: f"<main><h1>{p.a('title')}</h1><p>{p.a('in')} <span class='ad'>anno domini</span> five.</p>{p.ps(3)}<p class='skip'>{p.a()}</p></main>",
    "references": lambda p: f"<h1>{p.a('title')}</h1>{p.ps(3)}<h2>{p.a('references')}</h2><ol><li><a href=1>{p.a('one')}</a></li><li><a href=2>{p.a('two')}</a></li></ol>",
    "works with text": lambda p: f"<h1>{p.a('title')}</h1>{p.ps(3)}<ul><li>{p.a('a writer of it')} <a href=1>long title of the work itself</a></li><li>{p.a('b')} <a href=2>another title of a work</a></li></ul>",
    "reader comments": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(3)}</article><section class='comments'><h2>{p.o('comments')}</h2>" + "".join(f"<p>{p.o()}</p>" for _ in range(6)) + "</section>",
    "comments inside": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(4)}<div id=comments>" + "".join(f"<div class=comment><p>{p.o()}</p></div>" for _ in range(3)) + "</div></article>",
    "adverts inside": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(2)}<div class='ad banner'><p>{p.o()}</p></div>{p.ps(2)}<div class=sponsored>{p.o()}</div>{p.ps(1)}</article>",
    "divs alone": lambda p: f"<div class=top>{p.menu()}</div><div class=wrap><div class=content><h1>{p.a('title')}</h1>{p.ps(5)}</div><div class=side>{p.menu(8)}</div></div><div class=foot><a href=1>{p.o('terms')}</a> <a href=2>{p.o('contact')}</a></div>",
    "table layout": lambda p: f"<table><tr><td>{p.menu()}</td><td><h1>{p.a('title')}</h1>{p.ps(5)}</td></tr></table>",
    "data table": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(2)}<table><tr><th>{p.a('year')}</th><th>{p.a('count')}</th></tr><tr><td>{p.a('1990')}</td><td>{p.a('12')}</td></tr></table>{p.ps(1)}</article>",
    "sections without article": lambda p: f"<header><a href=/>{p.o('site')}</a></header><nav>{p.menu()}</nav><div id=main><h1>{p.a('title')}</h1><section>{p.ps(4)}</section><section><h2>{p.a('more')}</h2><p>{p.a('short.')}</p></section></div><footer>{p.o()}</footer>",
    "flat": lambda p: f"<h1>{p.a('title')}</h1>{p.ps(5)}{p.menu()}",
    "title outside": lambda p: f"<main><h1>{p.a('title')}</h1><article>{p.ps(5)}</article><aside>{p.o()}</aside></main>",
    "lists and quotes": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(1)}<ul><li>{p.a('first')}</li><li>{p.a('second')}</li></ul><blockquote><p>{p.a()}</p></blockquote><dl><dt>{p.a('word')}</dt><dd>{p.a()}</dd></dl>{p.ps(1)}</article>",
    "code and figure": lambda p: f"<article><h1>{p.a('title')}</h1>{p.ps(2)}<pre>{p.a('x = 1')}</pre><figure><img src=a><figcaption>{p.a('caption of it')}</figcaption></figure>{p.ps(2)}</article>",
    "cookie notice": lambda p: f"<div id=cookie-notice><p>{p.o()}</p><button>{p.o('accept')}</button></div><article><h1>{p.a('title')}</h1>{p.ps(3)}</article><form><p>{p.o()}</p></form>",
    "two articles": lambda p: f"<nav>{p.menu()}</nav><main><article><h2>{p.a('one')}</h2>{p.ps(3)}</article><article><h2>{p.a('two')}</h2>{p.ps(3)}</article></main>",
    "roles and hidden": lambda p: f"<div role=navigation>{p.menu()}</div><div role=main><h1>{p.a('title')}</h1>{p.ps(4)}<p hidden>{p.o()}</p><div style='display: none'><p>{p.o()}</p></div></div><div role=contentinfo>{p.o()}</div>",
    "nested wrappers": lambda p: f"<div><div><div><h1>{p.a('title')}</h1><div><p>{p.a()}</p><p>{p.a()}</p></div><div><p>{p.a()}</p><p>{p.a()}</p><p>{p.a()}</p></div></div></div><div>{p.menu(9)}</div></div>",
    "spanish ids": lambda p: f"<article id=post-12 class='post single'><h1>{p.a('título')}</h1><div class=entry>{p.ps(4)}</div><div class='newsletter'><p>{p.o()}</p></div></article>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_blocks_of_labelled_pages(shape):
    source = SHAPES[shape](Page())
    blocks = html.extract(f"<!DOCTYPE html><html><head><title>Off</title></head><body>{source}</body></html>").split("\n\n")
    wanted = set(re.findall(r"Art \d+", source))
    got = [m[0] for b in blocks for m in re.finditer(r"(Art|Off) \d+", b)]
    right = wanted & set(got)
    assert len(right) >= 0.95 * len(wanted), (shape, sorted(wanted - right))
    assert len(right) >= 0.95 * len(set(got)), (shape, sorted(set(got) - wanted))
    order = [int(x.split()[1]) for x in got if x.startswith("Art")]
    assert order == sorted(order)
