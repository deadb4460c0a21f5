"""Extraction of pages labelled by hand, of designs that the training layouts don't repeat."""

import pytest

from corpuskiln.llm import html_extract

NEWS = ["Rain in the valley", "The river rose by two metres overnight, and the council closed the old bridge before dawn.", "Nobody was hurt, a spokesman said, but forty families were asked to leave their homes.", "The bridge will be inspected when the water falls."]
P = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
PAGES = {
    "deep sidebar": f"<body><div class=sidebar>{'<div class=\"col inner wrap\">' * 8}<ul><li><a href=/a>Popular stories</a></li><li><a href=/b>More from us</a></li></ul>{'</div>' * 8}</div><article><h1>{NEWS[0]}</h1>{P(NEWS[1:])}</article></body>",
    "table": f"<body><table><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr><tr><td><h1>{NEWS[0]}</h1>{P(NEWS[1:])}</td></tr><tr><td>Copyright 2004 The Valley Post. All rights reserved.</td></tr></table></body>",
    "roles": f"<body><div role=navigation><a href=/>Home</a> <a href=/s>Sport</a></div><div role=main><h1>{NEWS[0]}</h1>{P(NEWS[1:])}</div><div role=complementary><h3>Related</h3><ul><li><a href=/1>Flood of 1987</a></li></ul></div><div role=contentinfo>&copy; 2020 Valley Post</div></body>",
    "main": f"<body><header><a href=/>Valley Post</a><nav><ul><li><a href=/a>World</a></li></ul></nav></header><main><h1>{NEWS[0]}</h1>{P(NEWS[1:])}</main><section class=comments><h2>2 comments</h2><article><p>Stay safe everyone!</p></article><article><p>We saw it from the hill.</p></article></section><footer><p>Contact us at the usual address.</p></footer></body>",
    "plain ids": f"<body><div id=a1><a href=/>Home</a> | <a href=/x>Archive</a></div><div id=a2><h1>{NEWS[0]}</h1>{P(NEWS[1:])}</div><div id=a3>Subscribe to our newsletter</div></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_the_article_and_nothing_else(html_model, name):
    text, _, _ = html_extract.main_texts([PAGES[name]], html_model, html_extract.Encoder())[0]
    assert text.split("\n") == NEWS
