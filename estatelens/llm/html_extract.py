"""Main text of web pages by boosted trees over their elements.

The model is fitted on a sample of at most ``TRAIN_PAGES`` pages of the table, labelled by what their
markup says outright (article and main elements against navigation, footers, asides, forms, comments and
the like). Pages without article or main say nothing and are left out of the fit; where fewer than
``MADE_PAGES`` others are found, made pages in plain containers fill up. So that the model learns more
than those names, each page is also taken with neutral names in changing dress and with boilerplate of
every kind put around and into the article. Elements of all pages are then scored, and a decision that is
free of contradictions along the tree picks the text.

The model is a few trees and the same for every page; pages are independent rows after that.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.boosting import Boosted
from estatelens.llm.dom import _ATTRIBUTE, _TOKEN, Page
from estatelens.llm.workers import slices, strings

#: Pages the model is fitted on at most.
TRAIN_PAGES = 160
#: Made pages that stand in for labelled ones.
MADE_PAGES = 40
MAIN = frozenset(["article", "main"])
ASIDE = frozenset(["nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu"])
#: Elements that are an article's own where they stand in one.
OWN = frozenset(["header"])
#: Words in class, id and role of containers that are no main text, also inside an article.
NOT_MAIN = frozenset(
    "ad ads comment comments share sharing social notice cookie consent disqus thread replies responses "
    "discussion reactions talkback".split()
)
#: Neutral dress for an article and for what is not.
MAIN_DRESS = ["post-content", "entry", "story-body", "content", "main-text", "article-body", "col-8", "x1"]
OTHER_DRESS = {
    "nav": ["menu", "navbar", "top-links", "breadcrumb"],
    "footer": ["footer", "site-foot", "copyright", "bottom"],
}
#: What articles hold besides paragraphs: tables, lists of links, headlines in a header.
INSIDE = [
    "<table><tr><th>{a}</th><th>{b}</th></tr><tr><td>{b}</td><td>{c}</td></tr><tr><td>{c}</td><td>{a}</td></tr></table>",
    "<table><tbody><tr><td>{a}</td><td>{b}</td></tr></tbody></table>",
    '<ul><li><a href="/">{a}</a></li><li><a href="/">{b}</a></li><li><a href="/">{c}</a></li></ul>',
    '<p>{c}</p><ol><li><a href="/">{a}</a> {b}</li><li><a href="/">{c}</a></li></ol>',
    "<header><h1>{a}</h1></header>",
    "<header><h1>{a}</h1><p>{b}</p></header>",
]
#: Containers of comment threads.
THREADS = ["disqus_thread", "responses", "discussion", "replies", "reactions", "talkback", "comment-thread"]
EXTRA = [
    *[
        f'<div data-no id="{name}"><div class="post"><b>{{c}}</b><p>{{a}}</p></div><div class="post"><b>{{a}}</b><p>{{b}}</p></div></div>'
        for name in THREADS
    ],
    '<aside data-no class="sidebar"><h3>{a}</h3><ul><li><a href="/">{b}</a></li><li><a href="/">{c}</a></li></ul></aside>',
    '<div data-no class="cookie-notice">{a} {b} <button>{c}</button></div>',
    '<div data-no class="advert">{a} {b}</div>',
    '<div data-no class="ad"><p>{a}</p></div>',
    '<section data-no id="comments"><h3>{c}</h3><div class="comment"><p>{a}</p></div><div class="comment"><p>{b}</p></div></section>',
    '<form data-no class="newsletter"><label>{a}</label><input><button>{b}</button></form>',
    '<header data-no><a href="/">{c}</a><p>{a}</p></header>',
    '<div data-no class="share"><a href="/">{a}</a> <a href="/">{b}</a></div>',
    '<div data-no class="related"><p><a href="/">{a}</a></p><p><a href="/">{b}</a></p></div>',
]


def made_page(number: int) -> str:
    """A labelled page in plain containers, the same for a number every time."""
    pick = random.Random(number)

    def words(least: int, most: int) -> str:
        lengths = [pick.randint(2, 10) for _ in range(pick.randint(least, most))]
        return " ".join("".join(pick.choices("aeionrstl", k=n)) for n in lengths)

    def sentences(least: int, most: int) -> str:
        return " ".join(words(6, 20).capitalize() + "." for _ in range(pick.randint(least, most)))

    def dressed(choices: list[str]) -> str:
        return f' class="{pick.choice(choices)}"' if pick.random() < 0.6 else ""

    def links(tag: str) -> str:
        each = [f'<a href="/">{words(1, 4)}</a>' for _ in range(pick.randint(3, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if tag == "ul" else " ".join(each)

    parts = [pick.choice(["<h1>{0}</h1>", "<h1>{0}</h1>", "<header><h1>{0}</h1></header>"]).format(words(3, 10))]
    for _ in range(pick.randint(2, 9)):
        parts.append(f"<p>{sentences(1, 6)}</p>")
        more = pick.random()
        if more < 0.15:
            parts.append(f"<h2>{words(2, 6)}</h2>")
        elif more < 0.25:
            parts.append("<ul>" + "".join(f"<li>{sentences(1, 1)}</li>" for _ in range(3)) + "</ul>")
        elif more < 0.3:
            parts.append(f"<blockquote>{sentences(1, 2)}</blockquote>")
        elif more < 0.45:
            parts.append(pick.choice(INSIDE).format(a=words(1, 8), b=words(1, 8), c=words(1, 8)))
    top, foot = OTHER_DRESS["nav"], OTHER_DRESS["footer"]
    side = f"<div data-no{dressed(['sidebar', 'related'])}><h3>{words(1, 3)}</h3>{links('ul')}</div>"
    body = f"<div data-yes{dressed(MAIN_DRESS)}>{''.join(parts)}</div>"
    middle = [body, side] if pick.random() < 0.5 else [side, body] if pick.random() < 0.5 else [body]
    return (
        f"<html><head><title>{words(2, 6)}</title></head><body>"
        f"<div data-no{dressed(top)}>{links(pick.choice(['ul', 'div']))}</div><div>{''.join(middle)}</div>"
        f"<div data-no{dressed(foot)}><p>{words(3, 9)}</p>{links('div')}</div></body></html>"
    )


def variant(source: str, words: list[str], number: int) -> str:
    """The page in another dress; number 0 leaves it as it is."""
    if not number:
        return source
    pick = random.Random(f"{number}:{len(source)}")

    def some(of: list[str] = EXTRA) -> str:
        return of[pick.randrange(len(of))].format(
            **{k: " ".join(pick.choices(words, k=pick.randint(2, 25))) for k in "abc"}
        )

    dress = pick.choice(MAIN_DRESS)
    out = source
    if number % 2:
        tag = pick.choice(["div", "section"])
        out = re.sub(r"<article\b", f'<{tag} data-yes class="{dress}"', out, flags=re.I)
        out = re.sub(r"</article\s*>", f"</{tag}>", out, flags=re.I)
        for name, choices in OTHER_DRESS.items():
            out = re.sub(rf"<{name}\b", f'<div data-no class="{pick.choice(choices)}"', out, flags=re.I)
            out = re.sub(rf"</{name}\s*>", "</div>", out, flags=re.I)
    start = re.search(r"<(?:article|div data-yes|section data-yes)[^>]*>", out)
    if start:
        if pick.random() < 0.7:  # at its beginning, or instead of all its paragraphs but the last
            close = re.compile(r"</(?:article|section)\s*>|</p>\s*</div>").search(out, start.end())
            whole = pick.random() < 0.2 and close and out.find("<div", start.end(), close.start()) < 0
            out = out[: start.end()] + some(INSIDE) + out[close.start() if whole else start.end() :]
        paragraphs = [m.end() for m in re.finditer(r"</p>", out) if m.start() > start.end()]
        if paragraphs:
            at = pick.choice(paragraphs)
            out = out[:at] + some() + out[at:]
            at = pick.choice([p for p in paragraphs if p <= at])
            out = out[:at] + some(INSIDE) + out[at:]
        out = out[: start.start()] + some() + out[start.start() :]
    end = max(out.rfind("</article>"), out.rfind("</section>"), out.rfind("</p></div>") + 4)
    if end > 4:
        close = out.find(">", end) + 1
        out = out[:close] + some() + out[close:]
    return out


def labels(page: Page) -> np.ndarray:
    """Which elements are main text by their markup: those inside an article and nothing else's."""
    out = np.zeros(len(page.tag), dtype=bool)
    for i in range(1, len(page.tag)):
        tag, said = page.tag[i], page.attributes[i]
        own = tag in OWN and out[page.parent[i]]
        no = (tag in ASIDE and not own) or "data-no" in said or re.search(r'class="(ad|ads|advert\w*)"', said)
        if not no and said and tag not in MAIN and "data-yes" not in said:
            no = not NOT_MAIN.isdisjoint(_TOKEN.findall(" ".join(_ATTRIBUTE.findall(said)).lower()))
        if no:
            out[i] = False
        else:
            out[i] = out[page.parent[i]] or tag in MAIN or "data-yes" in said
    return out


def fit(pages: list[str], variants: int = 4) -> Boosted:
    """The model from the pages that are labelled, and from made ones where these are few."""
    labelled = [source for source in pages if labels(Page(source)).any()]
    xs, ys = [], []
    for source in labelled + [made_page(i) for i in range(len(labelled), MADE_PAGES)]:
        words = re.sub(r"<[^>]*>", " ", source).split() or ["text"]
        for number in range(variants):
            page = Page(variant(source, words, number))
            xs.append(page.features())
            ys.append(labels(page))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(model: Boosted, sources: list[str]) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    features = [p.features() for p in pages]
    margins = model.margin(np.concatenate(features))
    edges = np.cumsum([0] + [len(f) for f in features])
    return [
        p.text_of(p.decide(margins[a:b])) for p, a, b in zip(pages, edges[:-1], edges[1:])
    ]


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    train_pages: int = TRAIN_PAGES,
    train_chars: int = 100_000,
) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    A null page is an empty one and has the empty text. Every row gives one row, also if it repeats
    another; an empty table gives none; null ids and urls stay null; other columns are not read. Pages of
    any length are read whole. Pages for the fit are ``train_pages`` different labelled ones of up to
    ``train_chars`` characters, those with the smallest hashes, so the same table gives the same model.
    """
    slim = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).alias("html"),
    )
    labelled = (
        slim.where(F.length("html").between(1, train_chars))
        .where(F.rlike("html", F.lit(r"(?i)<(?:article|main)[\s/>]")))
        .select("html", F.xxhash64("html").alias("h"))
    )
    # hashes first, eight bytes a page; then each of the pages once
    least = [r["h"] for r in labelled.select("h").distinct().orderBy("h").limit(train_pages).collect()]
    sample = labelled.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html"))
    model = fit([r["html"] for r in sample.orderBy("h").collect()] if least else [])

    def read(batches):
        for batch in slices(batches, 2, 4_000_000):
            texts = main_texts(model, strings(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, type=pa.string()),
                    pa.array([len(t) for t in texts], type=pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return slim.mapInArrow(read, "page_id long, url string, text string, n_chars long")
