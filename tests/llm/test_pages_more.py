"""Pages whose wrappers have telling names, and very deep ones."""

import time

import pytest

PARAGRAPH = "The council met on Tuesday and agreed to repair the old bridge before the winter comes, which the mayor welcomed in a short speech."


@pytest.mark.parametrize("n", [1, 2, 5, 20])
@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>", "<div class=ad-free>", "<div class=page-header-content>"])
def test_wrappers_of_the_article_dont_count_however_short_it_is(wrapper, n):
    from lexmill.llm.html_extract import main_text

    body = "".join(f"<p>{PARAGRAPH} {k}.</p>" for k in range(n))
    page = f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{wrapper}<h1>Bridge repaired</h1>{body}</{wrapper[1:].split()[0]}><footer>All rights reserved.</footer></body></html>"
    assert main_text(page) == "\n".join(["Bridge repaired", *(f"{PARAGRAPH} {k}." for k in range(n))])


def test_deep_pages_take_linear_time():
    from lexmill.llm.html_extract import main_text

    took = []
    for n in (4000, 8000):
        page = "<article>" + "".join(f"<div><p>{PARAGRAPH} {k}.</p>" for k in range(n)) + "</article>"
        began = time.process_time()
        text = main_text(page)
        took.append(time.process_time() - began)
        assert text.count("\n") == n - 1
    assert took[1] < 20 and took[1] < 4 * took[0] + 1


def test_evidence_far_above_still_counts():
    from lexmill.llm.html_extract import main_text

    deep = "<div>" * 40
    page = f"<body><article><h1>Title</h1><p>{PARAGRAPH}</p></article><div class=comments>{deep}<p>{PARAGRAPH} I agree.</p></body>"
    assert main_text(page) == f"Title\n{PARAGRAPH}"
