"""Long runs of equal bytes and grams that many benchmark texts share."""

import random
import resource
import time

from tests.llm.test_text_operators import edit_distance_in
from veriloom.llm import decontamination
from veriloom.llm.decontamination import Passages


def test_a_megabyte_of_blanks():
    item = b"a question, and the table:" + b" " * 300 + b"with its end here, after it"
    passages = Passages([(1, item), (2, b"-" * 200 + b"some text of its own, that is long enough to tell")])
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    got = passages.find([b"x" + b" " * 1_000_000 + b"y", b"-" * 300_000 + b"some text of its own, that is long enough to tell" + b" " * 1000, b"z" + item + b" " * 50_000])
    assert [(d, i) for d, i, *_ in got] == [(1, 2), (2, 1)]
    assert time.perf_counter() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_runs_against_brute_force(monkeypatch):
    monkeypatch.setattr(decontamination, "PRODUCT", 50)
    monkeypatch.setattr(decontamination, "RUN", 16)
    monkeypatch.setattr(decontamination, "HOT", 3)
    rng = random.Random(12)
    piece = lambda: rng.choice([b" " * rng.randint(3, 40), b"-" * rng.randint(3, 30), b"ab" * rng.randint(2, 12), b"=-+" * rng.randint(2, 12), b"abcab" * rng.randint(1, 6), b"| - | x" * rng.randint(1, 5), bytes(rng.choices(b"abcdefgh", k=rng.randint(3, 25)))])
    items = [(k, b"".join(piece() for _ in range(rng.randint(2, 6)))) for k in range(12)]
    items = [(k, t) for k, t in items if t.strip()]
    docs = []
    for _ in range(60):
        text = bytearray(b"".join(piece() for _ in range(3)) + rng.choice(items)[1] + b"".join(piece() for _ in range(3)))
        for _ in range(rng.choice([0, 1, 3, 6])):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1])] = rng.choice([b"", b"z", b" "])
        docs.append(bytes(text))
    got = {(d, i): e for d, i, _, _, e in Passages(items).find(docs)}
    want = {(d, i): n for d, text in enumerate(docs) for i, item in items if (n := edit_distance_in(item, text)) <= decontamination.edits_allowed(len(item))}
    assert got == want and len(want) > 60


def test_a_megabyte_of_each_period():
    """Text that repeats one to seven bytes is found, or ruled out, as fast as other text."""
    for unit in (b"ab", b"| ", b"=-", b"-=-", b"abc", b"=-=-", b"a b c", b"+----", b"=-+=-=", b"=-=--=-"):
        n = 300 // len(unit)
        passages = Passages([(1, unit * n), (2, b"a table: " + unit * n + b" and its end")])
        began = time.perf_counter()
        got = passages.find([b"x" + unit * (1_000_000 // len(unit)), unit[1:] + unit * (n // 2) + b"#" + unit * (n // 2), b"text, a table: " + unit * n + b" and its end" + unit * 1000])
        assert {(d, i) for d, i, *_ in got} >= {(0, 1), (1, 1), (2, 1), (2, 2)}
        assert time.perf_counter() - began < 20, unit
