"""Words of a class or id do not cut text out of an article."""

import pytest

from gaugeflow.llm import html

LONG = "This is a long paragraph of the article with a good many words in it."
PARTS = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
WHOLE = ["Head", LONG, LONG, LONG]
CASES = {
    "wrapper with article": (f"<div class='layout has-sidebar'><article>{PARTS}</article></div>", WHOLE),
    "wrapper of the page": (f"<div id='page' class='sticky-header'><div>{PARTS}</div></div>", WHOLE),
    "wrapper and sidebar": (f"<div class='has-sidebar'><main>{PARTS}</main><div class='sidebar'>"
                            f"<p>{LONG}</p></div></div>", WHOLE),
    "article with comments open": (f"<article class='post comments-open'>{PARTS}</article>", WHOLE),
    "slugs": (f"<article>{PARTS}<h2 id='discussion'>Discussion</h2><p>{LONG}</p><h2 id='privacy'>"
              f"Privacy</h2><section id='related-work'><h2>Related</h2><p>{LONG}</p></section></article>",
              [*WHOLE, "Discussion", LONG, "Privacy", "Related", LONG]),
    "slugs without an article": (f"<div>{PARTS}<h2 id='legal'>Legal</h2><p>{LONG}</p></div>",
                                 [*WHOLE, "Legal", LONG]),
    "parts of a line": ("<article><p>Please <a class='register-link' href='/r'>register</a> and see "
                        f"<span class='popup'>the terms</span> first.</p>{PARTS}</article>",
                        ["Please register and see the terms first.", *WHOLE]),
    "paragraph": (f"<article>{PARTS}<p class='notice'>{LONG}</p></article>", [*WHOLE, LONG]),
    # what must go on being left out
    "list of links": (f"<article>{PARTS}<ul class='related'><li><a href='/1'>One</a></li><li>"
                      "<a href='/2'>Two</a></li></ul></article>", WHOLE),
    "comments": (f"<article>{PARTS}<section id='comments'><article class='comment'><p>{LONG}</p>"
                 f"</article></section></article><div class='comments'><article class='comment'>"
                 f"<p>{LONG}</p></article></div>", WHOLE),
    "longer comments": (f"<article>{PARTS}<section id='comments'>{PARTS * 3}</section></article>",
                        WHOLE),
    "teasers": (f"<article>{PARTS * 2}</article><div class='related'><article><p>Short</p></article>"
                "</div>", WHOLE * 2),
}


@pytest.mark.parametrize("name", CASES)
def test_classes(name):
    body, blocks = CASES[name]
    found = html.main_text(f"<!DOCTYPE html><html><body>{body}</body></html>")
    assert found == "\n\n".join(blocks)
