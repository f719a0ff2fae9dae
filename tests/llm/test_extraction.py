import sys
import time
from pathlib import Path

import numpy as np
import pytest

from catalox.llm import extraction
from catalox.llm.dom import Page, features
from catalox.llm.layouts import training_page

sys.path.insert(0, str(Path(__file__).parent))
from labelled_pages import PAGES


@pytest.fixture(scope="module")
def trees():
    return extraction.fitted()


def test_training_leads_to_the_fitted_trees(spark, trees):
    """A smaller fit of the same kind mostly agrees with the saved trees on pages that neither has seen; saving loses nothing."""
    fresh = extraction.train(spark, pages=200, trees=8)
    x = features([Page(training_page(np.random.default_rng([7, i]))) for i in range(40)])
    assert ((fresh.log_odds(x) > 0) == (trees.log_odds(x) > 0)).mean() > 0.93
    assert np.allclose(extraction.Trees.from_json(fresh.to_json()).log_odds(x), fresh.log_odds(x), atol=1e-4)


@pytest.mark.parametrize("name", sorted(PAGES))
def test_hand_labelled_pages(trees, name):
    """Main text of pages in layouts that the generator does not make: shares of code points found and right."""
    html, blocks = PAGES[name]
    got = extraction.main_texts([html], trees)[0].split("\n\n")
    both = sum(len(x) for x in blocks if x in got)
    assert both / sum(map(len, blocks)) > 0.9, got
    assert both / max(1, sum(map(len, got))) > 0.9, got


def test_held_out_pages(trees):
    """Pages of other seeds than those of the training: blocks kept and dropped as they are marked."""
    right = total = 0
    for i in range(150):
        page = Page(training_page(np.random.default_rng([99, i])), marked=True)
        want = []
        for mark, parent in zip(page.mark, page.parent, strict=True):
            want.append(mark if mark >= 0 else want[parent] if parent >= 0 else 0)
        text = extraction.main_texts([training_page(np.random.default_rng([99, i]))], trees)[0]
        truth = "\n\n".join(t for node, t in page.blocks if want[node] == 1)
        right += sum(len(x) for x in set(text.split("\n\n")) & set(truth.split("\n\n")))
        total += max(len(text), len(truth))
    assert right / total > 0.93


def test_decoding_is_closed_towards_the_root(trees):
    pages = [Page(training_page(np.random.default_rng([5, i]))) for i in range(10)]
    rng = np.random.default_rng(0)
    for page, kept in zip(pages, extraction.decode(pages, rng.normal(size=sum(len(p.tag) for p in pages))), strict=True):
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_decoding_is_the_best(trees):
    page = Page("<div><p>a</p><section><p>b</p><p>c</p></section></div>")
    rng = np.random.default_rng(1)
    for _ in range(50):
        odds = rng.normal(size=len(page.tag))
        best, worth = 0.0, lambda keep: odds[keep].sum() - sum(keep[page.parent[i]] and not keep[i] for i in range(1, len(keep)))  # noqa: B023
        for bits in range(1 << len(odds)):
            keep = [bool(bits >> i & 1) for i in range(len(odds))]
            if all(keep[page.parent[i]] for i in range(1, len(keep)) if keep[i]):
                best = max(best, float(worth(np.array(keep))))
        kept = np.array(extraction.decode([page], odds, 1.0)[0])
        assert (worth(kept) if kept.any() else 0.0) == pytest.approx(best)


def test_parsing():
    page = Page("<body><p>A &amp; B<br>C  <b>d</b>\n<p>next<ul><li>x<li>y</ul><script>if (a < b) '</p>'</script><!-- <p>no</p> -->tail")
    assert [t for _, t in page.blocks] == ["A & B C d", "next", "x", "y", "tail"]
    assert [t for _, t in Page("").blocks] == [] and [t for _, t in Page("<p").blocks] == []
    assert [t for _, t in Page("<div>" * 3000 + "deep").blocks] == ["deep"]


def test_broken_markup():
    """Skipped elements that nothing closes lose no later text, marks in the wild mean nothing, nested ones end together."""
    read = lambda x: [t for _, t in Page(x).blocks]
    assert read("<article>a<p><button>Go<p>long paragraph") == ["a", "Go", "long paragraph"]
    assert read('<p data-k="x">one<p data-k=7>two') == ["one", "two"]
    assert read("<p>a<svg><svg>n</svg>m</svg>b<select><option>x</select>c") == ["abc"]
    assert read("<p>a<math>1+2</math><noscript>b</noscript>") == ["a1+2b"]
    assert read("<p>a<script>var x = 1;<p>b") == ["a"]


@pytest.mark.parametrize("text", ["<div>" * 200_000 + "deep", "<div>" * 50_000 + "x" + "</section>" * 50_000, "<div><li>" * 100_000, "<button>x" * 100_000, "<div class='a'><p>x</p>" * 45_000])
def test_large_pages_take_linear_time(text, trees):
    """A page of about 1 MB: two seconds here, with room for slower machines."""
    start = time.process_time()
    page = Page(text)
    extraction.decode([page], trees.log_odds(features([page])))
    assert time.process_time() - start < 6


def test_edges(spark, trees):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>x</p>", 3), (1, "u", "<html><body><article><h1>Title here</h1>" + "<p>One sentence of prose, and then another one follows it.</p>" * 30 + "</article></body></html>", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extraction.extract(df, trees).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 2] == [""]
    assert max(r.n_chars for r in got) > 1500
    assert extraction.extract(df.limit(0), trees).count() == 0
