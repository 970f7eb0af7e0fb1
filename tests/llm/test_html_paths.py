"""Pages that don't name their article, that hold unmarked boilerplate, or whose marks mislead."""

import re

import pytest

from veriloom.llm.html_extraction import main_text

LONG = [f"Paragraph {k}, which is part of the article, goes on for a while; it has commas, stops, and more than a few words in it. It ends here." for k in range(6)]
PARAS = "".join(f"<p>{t}</p>" for t in LONG)
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(8)) + "</ul>"
PLAIN = "<ul>" + "".join(f"<li>{t}</li>" for t in ("Print", "Mail", "Text size", "Report", "Save")) + "</ul>"


def test_unmarked_boilerplate_inside_the_article():
    assert main_text(f"<body><article><h1>Head</h1>{LINKS}{PARAS}{PLAIN}</article></body>").split("\n") == ["Head", *LONG]
    assert main_text(f"<body><main>{PLAIN}{PARAS}<div><div>{LINKS}</div></div></main></body>").split("\n") == LONG


def test_page_without_an_article_element():
    page = f"<body><div>{LINKS}</div><div><h2>Head</h2><p>Short, first.</p>{PARAS}<p>Short, last.</p></div><div>{PLAIN}</div></body>"
    assert main_text(page).split("\n") == ["Head", "Short, first.", *LONG, "Short, last."]


def test_lists_of_the_article_stay():
    items = [f"Item {k} of the list says something, in a line." for k in range(5)]
    page = f"<article>{PARAS}<ul>{''.join(f'<li>{t}</li>' for t in items)}</ul><p>{LONG[0]}</p></article>"
    assert main_text(page).split("\n") == [*LONG, *items, LONG[0]]


def test_one_long_paragraph_is_not_the_holder():
    assert main_text(f"<body><div><p>{' '.join(LONG * 5)}</p><p>Short, last one, still here.</p></div></body>").endswith("\nShort, last one, still here.")


@pytest.mark.parametrize(
    "before, after",
    [("<div class='content with-sidebar'>", "</div>"), ("<div id='page' class='no-sidebar'>", "</div>"), ("<article class='post comments-open'>", "</article>"), ("<form action='/'>", "</form>"), ("<div role='form' class='no-sidebar'><div class='with-banner'>", "</div></div>")],
)
def test_marks_of_the_whole_page_do_not_count(before, after):
    small = f"<div class='comments'><p>A reader, says this.</p></div><div class='sidebar'>{LINKS}<p>Buy, now.</p></div>"
    assert main_text(f"<body>{before}{PARAS}{small}{after}<footer>Us, here.</footer></body>").split("\n") == LONG


def test_marked_parts_like_the_article_stay_and_comments_go():
    posts = "".join(f"<div class='post comments-open'>{PARAS}</div>" for _ in range(3))
    assert main_text(f"<body>{posts}<div class='share'>Share, this.</div></body>").split("\n") == LONG * 3
    thread = "<div class='comments'>" + "".join(f"<div class='comment'><p>{t}</p></div>" for t in LONG * 3) + "</div>"
    assert main_text(f"<body><article>{PARAS}</article>{thread}</body>").split("\n") == LONG
    assert main_text(f"<body><div>{PARAS}</div>{thread}</body>").split("\n") == LONG


def test_inline_pieces_stand_aside_one_by_one():
    page = f"<body><div><p><span class='share'>Share</span>{LONG[0]}</p><p>{LONG[1]} <span class='ad'>Buy</span></p><p>{LONG[2][:40]}<i hidden>no</i>{LONG[2][40:]}</p></div></body>"
    assert main_text(page).split("\n") == LONG[:3]


def test_headings_stay_with_something_of_their_section():
    page = f"<body><article><h1>Head</h1>{LINKS}<h2>Part</h2><h3>Sub</h3>{PARAS}<h3>None</h3>{LINKS}<h2>Share</h2><h3>More</h3>{PLAIN}</article></body>"
    assert main_text(page).split("\n") == ["Head", "Part", "Sub", *LONG]


MATTER = [
    "<table><tr><td>alpha</td><td>42</td></tr></table>", "<pre>x = 1</pre>", "<blockquote>Short</blockquote>", "<figure><img src=x><figcaption>A cat</figcaption></figure>", "<dl><dt>term</dt><dd>meaning</dd></dl>",
    '<section id="menu-design"><p>Menus are designed, so to say.</p></section>', "<p id=banner>Banner text, here.</p>", '<pre>a <em class="token comment">note</em> b</pre>',
]
LISTS = ["<ul><li>apples</li><li>pears</li></ul>", '<h2 id="market-share">Market</h2>', '<h2 id="login-flow">Login</h2>', "<h3 class='section-title'>Title</h3>"]


@pytest.mark.parametrize("piece", MATTER + LISTS)
def test_short_parts_of_the_article_stay(piece):
    """Tables, lists, code, quotes, captions and headings, whose names may hold a word of boilerplate; a list or heading without text after it is none of the article."""
    said = re.sub("<[^>]*>", " ", piece).split()
    for page in ("<body><nav><a href=x>Home</a></nav><article>%s</article><footer>f</footer></body>", "<body><div>%s</div></body>"):
        for at in (3, 6) if piece in MATTER else (3,):
            got = main_text(page % "".join([*(f"<p>{t}</p>" for t in LONG[:at]), piece, *(f"<p>{t}</p>" for t in LONG[at:])]))
            assert [t for t in got.split("\n") if t in LONG] == LONG and all(w in got.split() for w in said)


def test_a_short_second_part_stays():
    page = f"<body><div>{PARAS * 3}</div><section><p>A second section, which is short.</p></section></body>"
    assert main_text(page).endswith("A second section, which is short.")


def test_pages_equal_their_articles():
    """The pages of the table name their articles, so a few lines of regexes read them too."""
    from html import unescape

    import pyarrow.parquet as pq

    from tests.oracle import DATA

    for html in pq.read_table(f"{DATA}/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist()[:500]:
        body = re.search("<article>(.*)</article>", html, re.S)[1]
        body = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", body, flags=re.S)
        blocks = [" ".join(unescape(re.sub("<(?!br)[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", body)]
        assert main_text(html) == "\n".join(x for x in blocks if x)
