import itertools

import pytest
from cases import told

from filigree.llm.html_crf import Chain, labelled_pages, leaf_blocks, main_texts, own_features, trained


def test_decoding_finds_the_best_labels():
    chain = Chain({}, [[0.4, -0.9], [-0.3, 0.8]], [0.2, -0.2])
    for scores in ([0.5, -2.0, 1.0, -0.1, 0.3], [-1.0], [3.0, -4.0, 3.0, -0.5]):
        def total(labels):
            steps = sum(chain.steps[a][b] for a, b in zip(labels, labels[1:]))
            return chain.starts[labels[0]] + steps + sum(s for s, y in zip(scores, labels) if y)

        best = max(itertools.product((0, 1), repeat=len(scores)), key=total)
        assert chain.decode(scores) == list(best)
    assert chain.decode([]) == []


def test_labelled_pages_that_were_not_fitted():
    chain, wrong, blocks = trained(), 0, 0
    for page in labelled_pages(150, seed=77):
        found = leaf_blocks(page, chain.weights)
        labels = chain.decode([b.node.score + sum(chain.weights.get(f, 0) for f in own_features(b)) for b in found])
        wrong += sum(y != (b.node.label or 0) for y, b in zip(labels, found))
        blocks += len(found)
    assert wrong < 0.03 * blocks


LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "About", "Contact"))
PROSE = "The first words of a story, and more of them. It goes on for a while, as stories do."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><div class="logo">Daily News</div></header><nav><ul>{LINKS}</ul></nav>
<div class="cookie-notice"><p>We use cookies to improve your experience.</p><button>Accept all</button></div>
<article><h1>A   title &amp; more</h1><p>{PROSE}<p>{PROSE} caf&eacute; &#8364;5&nbsp;x<br>next <b>bold</b>ly</p>
<div class="ad">Buy now and save</div><!-- <p>hidden</p> --><p>Last words of the story, which ends here. {PROSE}</p></article>
<aside class="sidebar"><h3>Related articles</h3><ul>{LINKS}</ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Tom says</p><p>I liked this. {PROSE}</p></div></section>
<form action="/s"><label>Subscribe to our newsletter</label><input name=q></form>
<footer>&copy; 2024 Example Ltd. All rights reserved.</footer></body></html>"""


def test_article_without_the_rest():
    text = trained().main_text(PAGE)
    assert text.split("\n\n") == [
        "A title & more", PROSE, f"{PROSE} café €5 x next boldly", f"Last words of the story, which ends here. {PROSE}",
    ]


@pytest.mark.parametrize("page", ["<", "<p", "</p></div>", "<script>x", "<!--", "<a href='", "<" * 5000, "<div>" * 3000 + "x", "&#0;&bogus;", "<p a=\"b>c", "\x00"])
def test_broken_markup(page):
    trained().main_text(page)


def test_awkward_pages(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, None), (None, "v", "", 1), (3, "w", "<nav>" + LINKS * 200 + "</nav>", 0)]
    frame = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long"))
    got = told(frame, "page_id", "url", "text", "n_chars")
    assert len(got) == 5 and all(len(t) == n for _, _, t, n in got)
    assert (2, None, "", 0) in got and (None, "v", "", 0) in got and (3, "w", "", 0) in got
    assert told(main_texts(frame.withColumnRenamed("text", "html").where("false"))) == []
