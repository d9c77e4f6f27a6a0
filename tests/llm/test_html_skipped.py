"""Skipped elements without an end tag take no article text with them."""

from __future__ import annotations

import pytest

from poolwright.llm import html_text

LIST = "<datalist><option value=a><option value=b></datalist>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body>{LIST}<p>one</p><p>two</p></body>", "one two"),
        (f"<body>{LIST}<p>one</p><select><option>x</option></select><p>two</p></body>", "one two"),
        ("<div><select><option>a<option>b</div><p>one</p>", "one"),
        ("<table><tr><td><select><option>a</td><td>one</td></tr></table>", "one"),
        *((f"<body><div>zero <{t}>no<b>no</b></div><p>one</p></body>", "zero one") for t in ("svg", "math", "object", "iframe", "noscript", "template", "select")),
        ("<p>a <svg><title>no<g><svg>no</svg>no</g></svg> b</p><p>c</p>", "a b c"),
        ("<p>a</p><noscript><p>no</p></noscript><p>b</p>", "a b"),
        ("<SELECT><OPTGROUP><OPTION>no</OPTGROUP></SELECT><p>é</p>", "é"),
        ("<p>a</p><script>var x = '</p><p>no</p>'", "a"),
        ("<p>a<span/> b</p><svg/><p>c</p>", "a b c"),
    ],
)
def test_text_after_unclosed_elements_stays(page, want):
    assert " ".join(b.text for b in html_text.cut_blocks(page)) == want


def test_deep_skipped_content_is_linear():
    assert html_text.cut_blocks("<svg>" + "<g></x>" * 100_000 + "</svg><p>a</p>")[0].text == "a"
