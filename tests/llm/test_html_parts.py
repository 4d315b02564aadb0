"""Parts of pages that blocks() may not lose: bodies after an open head, formulas and fallback texts."""

import time

from featureflow.llm import html_text

STORY = "<article><h1>Some title</h1><p>First words of a long story, and more of it.</p><p>Then it ends here.</p></article>"
TEXTS = ["Some title", "First words of a long story, and more of it.", "Then it ends here."]


def _texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_open_head():
    head = "<html><head><meta charset=utf-8><title>T</title><style>p{}</style><template><p>no</p></template><link href=x>"
    for between in ("", "<body>", "</head><body>", "\n<body class=a>", "<div>", "<img src=x>"):
        assert _texts(f"<!doctype html>{head}{between}{STORY}") == TEXTS
    assert _texts(f"{head}Text first{STORY}") == ["Text first", *TEXTS]
    assert html_text.default_model().extract(f"{head}<body>{STORY}") == "\n\n".join(TEXTS)
    assert _texts(head) == []


def test_formulas_and_fallback_texts():
    page = "<body><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><object data=a><p>Told instead.</p></object>"
    page += "".join(f"<{t}>For {t}.</{t}>" for t in ("audio", "video", "canvas")) + "<svg><text>no</text></svg><p>End."
    assert _texts(page) == ["Let x=2 hold.", "Told instead.", "For audio.", "For video.", "For canvas.", "End."]
    labelled = "<p><math><semantics><mi>y</mi><annotation encoding=tex>\\y</annotation></semantics></math> grows"
    assert _texts(labelled) == ["y grows"]


def test_headers_and_comments_inside_an_article():
    extract = html_text.default_model().extract
    story = "<p>First words of a long story, and more of it. It goes on for a while, and then some.</p>"
    rest = "<p>Then it ends here, with a last line. Nothing else is told after that.</p>"
    told = "First words of a long story, and more of it. It goes on for a while, and then some."
    end = "Then it ends here, with a last line. Nothing else is told after that."
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav>{}<footer>&copy; Us</footer></body></html>"
    got = extract(page.format(f"<article><header><h1>Title of it</h1></header>{story}{rest}</article>"))
    assert got == f"Title of it\n\n{told}\n\n{end}"
    got = extract(page.format(f'<article><div class="entry-header"><h1>Title of it</h1></div>{story}{rest}</article>'))
    assert got == f"Title of it\n\n{told}\n\n{end}"
    remark = "I liked this one a lot, thanks for it. Will come back."
    for comments in (f'<div class="comments"><p>{remark}</p></div>', f'<ol class="commentlist"><li><p>{remark}</p></li></ol>', f'<div class="usercomments"><p>{remark}</p></div>'):
        assert extract(page.format(f"<article><h1>Title of it</h1>{story}{comments}{rest}</article>")) == f"Title of it\n\n{told}\n\n{end}", comments
        assert extract(page.format(f"<article><h1>Title of it</h1>{story}{rest}{comments}</article>")) == f"Title of it\n\n{told}\n\n{end}", comments


def test_deep_and_unclosed_tags_take_little_time():
    start = time.perf_counter()
    pages = ["<div>x" * 50_000, "<span>x</b>" * 50_000, "<b><div>" + "<span>x</b>" * 50_000, "<p><li>x" * 50_000, "<ul><li>x" * 25_000, "<noscript>" + "<i><p>" * 50_000]
    for page in pages:
        html_text.default_model().decode(html_text.blocks(page))
    assert time.perf_counter() - start < 30
