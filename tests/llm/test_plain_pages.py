"""Main text of ordinary pages: containers of any name beside menus, headers, asides and footers; drawings, objects, fields."""

from __future__ import annotations

import pytest

from mediamill.llm import htmltext

LINES = ["The river ran past the old mill.", "We waited until the evening came and then we left.", "Nobody had seen the boat since Tuesday morning, they said.", "It was cold."]
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>Contact</a></li></ul></nav>"
ASIDE = "<aside><h3>Related posts</h3><ul><li><a href='#'>One thing</a></li><li><a href='#'>Another thing</a></li></ul></aside>"
FOOT = "<footer>© 2024 Example Corp. All rights reserved.</footer>"
SHAPES = {
    "footer by name": "<div>{p}</div><div class='footer'>© 2024 Example. Terms.</div>",
    "a word of no meaning": "<div class='xyz'>{p}</div>" + FOOT,
    "columns": NAV + "<div class='container'><div class='col'>{p}</div></div>" + FOOT,
    "role": "<header><a href='/'>Site name</a></header><div role='main' class='col-md-8'>{p}</div>" + ASIDE + FOOT,
    "all in one": "<div id='app'><div class='wrapper'>" + NAV + "<div class='page'>{p}</div>" + ASIDE + "</div></div>" + FOOT,
    "no container": NAV + "{p}" + FOOT,
    "main": NAV + "<main>{p}</main>" + FOOT,
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_text_in_plain_containers_stays(shape, n):
    texts = [f"{LINES[k % 4]} {LINES[(k + 1) % 4]}" for k in range(n)]
    page = SHAPES[shape].format(p="".join(f"<p>{t}</p>" for t in texts))
    assert htmltext.main_text(page, htmltext.train()).split("\n") == texts


def test_made_pages_of_other_names():
    """Blocks of pages by another seed, whose containers have words that training never saw."""
    field = htmltext.train()
    right = kept = wanted = 0
    for page, labels in htmltext.labelled_pages(300, seed=1234):
        found = field.decode(htmltext.features(htmltext.leaf_blocks(page)))
        if len(found) == len(labels):
            right += sum(a and b for a, b in zip(found, labels))
            kept, wanted = kept + sum(found), wanted + sum(labels)
    assert right / kept >= 0.98 and right / wanted >= 0.98


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<svg><svg></svg><text>leak</text></svg>", ""),
        ("<svg><title>x</title><g><text>leak</text></g></svg>", ""),
        ("<svg viewBox='0'/>", ""),
        ("<math><mi>x</mi><math></math><mo>=</mo></math>", ""),
        ("<svg><foreignObject><p>leak</p></foreignObject></svg>", ""),
        ("<object data='x'><p>Shown where the thing can't be.</p></object>", "Shown where the thing can't be."),
        ("<textarea>type <b>here</b></textarea>", ""),
    ],
)
def test_drawings_objects_and_fields(inside, want):
    page = f"<article><p>Hello there, world of words.</p>{inside}<p>More text comes here.</p></article>"
    assert htmltext.main_text(page, htmltext.train()).split("\n") == ["Hello there, world of words.", *([want] if want else []), "More text comes here."]


def test_an_unclosed_drawing_ends_at_the_next_paragraph():
    assert [b.text for b in htmltext.leaf_blocks("<p>a</p><svg><text>no<p>b</p>")] == ["a", "b"]


def test_one_field_for_a_process():
    assert htmltext.train() is htmltext.train()
