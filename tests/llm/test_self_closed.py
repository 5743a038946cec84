"""Self-closed svg and math elements end at their slash."""

import pytest

from outvote.llm.dom import parse
from outvote.llm.html_text import main_texts, train

LINE = "Lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor incididunt ut labore."


@pytest.mark.parametrize("mark", ['<svg width="1" />', "<math/>", '<svg><path d="M0"/><a/><g/></svg>', "<svg><foreignObject><div/>x</div></foreignObject></svg>"])
def test_text_after_a_self_closed_element_stays(mark):
    html = f"<nav>n</nav><article><h1>Head</h1>{mark}<p>{LINE}</p><p>before {mark}after {LINE}</p></article>"
    assert main_texts(train(), [parse(html)]) == [f"Head\n{LINE}\nbefore after {LINE}"]


def test_a_slash_counts_only_in_foreign_elements():
    assert [t for _, t in parse("<div/>one<p/>two<script/>").segments] == ["one", "two"]
    assert [t for _, t in parse("<p>a<span/>b <svg>hidden</svg>c<a/>d</p>").segments] == ["ab cd"]
