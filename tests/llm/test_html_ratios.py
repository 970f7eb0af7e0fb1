"""The tag paths' scores against a plain version, node by node, and what they decide."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.test_html_paths import LINKS, LONG, PARAS, PLAIN
from tests.oracle import DATA
from veriloom.llm import html_extraction
from veriloom.llm.html_extraction import SPAN, Page, main_text, path_scores


def by_node(lengths, marks, paths):
    """Each block's two scores: loops over blocks, no arrays."""
    plain, smooth = [1.0] * len(paths), [1.0] * len(paths)
    for values in (lengths, marks):
        ratio = [sum(v for v, q in zip(values, paths, strict=True) if q == p) / paths.count(p) for p in paths]
        for k, r in enumerate(ratio):
            near = [ratio[min(max(j, 0), len(ratio) - 1)] for j in range(k - SPAN, k + SPAN + 1)]
            plain[k] *= r + 1
            smooth[k] *= sum(near) / len(near) + 1
    return [x**0.5 for x in plain], [x**0.5 for x in smooth]


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(f"{DATA}/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist()[:500]


def test_scores_equal_the_plain_version(pages):
    for html in pages:
        page = Page(html or "")
        if page.text:
            lengths, marks = [len(t) for t in page.text], [len(html_extraction._PUNCTUATION.findall(t)) for t in page.text]
            got = path_scores(np.array(lengths, float), np.array(marks, float), np.array(page.path))
            for x, y in zip(got, by_node(lengths, marks, page.path), strict=True):
                assert np.allclose(x, y)


def test_scores_decide(monkeypatch):
    """With scores that are all alike, unmarked boilerplate stays in the article."""
    page = f"<body><article><h1>Head</h1>{LINKS}{PARAS}{PLAIN}</article></body>"
    assert main_text(page).split("\n") == ["Head", *LONG]
    monkeypatch.setattr(html_extraction, "path_scores", lambda length, marks, path: (np.ones(len(path)), np.ones(len(path))))
    assert "Print" in main_text(page)


def test_unclosed_pictures_do_not_end_the_page():
    for tag in ("svg", "math", "template", "noscript"):
        assert main_text(f"<body><article>{PARAS[: len(PARAS) // 2]}<{tag} class='x'>{PARAS}</article></body>").split("\n")[-1] == LONG[-1]
    assert main_text(f"<body><article>{PARAS}<script>var x = 1;{PARAS}").split("\n") == LONG
