"""Maps over texts: secrets, HTML, benchmark passages, tokens, languages, toxicity, URLs."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, same
from veriloom.llm import decontamination, html_extraction, language_id, secret_scans, token_counts, toxicity, url_filters
from veriloom.llm.oracles import ORACLES
from veriloom.llm.queries import QUERIES

SF = f"{DATA}/sf0.001"
#: null ids and texts, empty and blank texts, a repeated row, a long text, and a column whose name clashes.
ROWS = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "  \n", "y"), (None, "some words here", "z"), (5, "long words " * 30_000, "x")]
KIND = "doc_id long, text string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, KIND)


def n_rows(df):
    return len(df.collect())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_duckdb(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], "sf0.001")


def test_secrets_brute_force(spark, odd):
    rng = random.Random(1)
    bits = ["password", "PassWD", "api_key", "apikey=", "token", ": ", '"', "AKIA" + "A1" * 9, "deadbeef" * 3, "ghp_" + "a" * 36, "é", " ", "=", "x" * 13, "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choices(bits, k=30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scans.find_secrets(df).collect()}
    for k, t in enumerate(texts):
        want = [(m.start(), i, m.end()) for i, r in enumerate(secret_scans.RULES) for m in re.compile(r.pattern, re.A).finditer(t) if len(m[r.group]) >= r.least]
        assert got[k] == [(secret_scans.RULES[i].kind, a, b) for a, i, b in sorted(want)]
    digest = secret_scans.secret_digest(secret_scans.find_secrets(odd)).collect()
    assert len(digest) == len(ROWS) and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in digest)
    assert n_rows(secret_scans.find_secrets(odd.where("false"))) == 0


def test_trigram_queries():
    assert secret_scans.trigram_query("[0-9a-f]+") == ("all",)
    assert secret_scans.trigram_query("AKIA[A-Z0-9]+") == ("and", (("tri", "aki"), ("tri", "kia")))
    assert secret_scans.trigram_query("abc|xyz") == ("or", (("tri", "abc"), ("tri", "xyz")))


def test_redaction(spark):
    df = spark.createDataFrame([(1, 'token="abcdefghijklmnop" é', 26, "k"), (2, None, None, "k"), (3, "clean", 99, None)], "doc_id long, text string, n_chars long, kind string")
    assert [tuple(r) for r in secret_scans.redact_secrets(df, length_col="n_chars").collect()] == [(1, '[assign]" é', 11, "k"), (2, None, None, "k"), (3, "clean", 99, None)]
    taken = df.selectExpr("*", "777L AS veriloom_len", "777L AS VERILOOM_LEN_")
    assert [tuple(r)[-2:] for r in secret_scans.redact_secrets(taken, length_col="n_chars").collect()] == [(777, 777)] * 3


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name, menu.</h1></header><nav><ul><li><a>Home, page.</a></li></ul></nav>
<article><h1>Head</h1><p>First&nbsp;para,  with <b>bold</b> text &amp; more words.</p><script>var x = "<p>no</p>";</script><p>Second para, of the article, is here.</p><div class="ad">Buy, now.</div></article>
<div class="comments"><p>A reader, says this.</p></div><footer>Copyright, us.</footer></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 1), (3, "u", "", 2), (None, "u", "<p>Just a text, with a comma.", 3), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in html_extraction.extract_text(df).select("page_id", "text", "n_chars").collect()]
    text = "Head\nFirst para, with bold text & more words.\nSecond para, of the article, is here."
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (None, "Just a text, with a comma.", 26), (1, text, len(text))]
    assert n_rows(html_extraction.extract_text(df.where("false"))) == 0


def edit_distance_in(want: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for a in want:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 12, 20, 30, 30, 40])] + [(9, None), (10, ""), (0, "abcd")]
    docs = []
    for k in range(60):
        text = list(rng.choice(items[:6])[1])
        for _ in range(rng.choice([0, 0, 2, 6, 12, 20, 30])):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "Q", "zz"])
        docs.append((k, " ".join(word() for _ in range(20)) + " " + "".join(text).upper() + "\n" + " ".join(word() for _ in range(10))))
    docs += [(100, None), (101, ""), (None, items[2][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(d, b).collect()}
    want = {}
    for i, text in docs:
        if i is None or not text:
            continue
        for j, item in items:
            if item and item.strip():
                t, w = decontamination.folded(text), decontamination.folded(item)
                n = edit_distance_in(w, t)
                if n <= decontamination.edits_allowed(len(w)):
                    want[i, j] = min(n, want.get((i, j), n))
    assert got == want and len(want) > 20
    kept = {r["doc_id"] for r in decontamination.keep_clean(d, b).collect()}
    assert kept == {i for i, _ in docs if i is not None} - {i for i, _ in want}
    assert n_rows(decontamination.contaminated(d, b.where("false"))) == 0 and n_rows(decontamination.contaminated(d.where("false"), b)) == 0


def test_token_counts_equal_the_library(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    hard = ["<s> </s> <unk> [INST]", "a\tb\n\nc", "日本語 テスト", "naïve façade 😀 😀😀", "▁▁x ▁", "aaaa" * 50, " lead", "trail ", "1234567890 3.14", "\x00\x01", "é", "'s don't " * 40]
    rows = [(k, t) for k, t in enumerate(hard)] + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {k: (len(t.encode()), len(lib.encode(t))) for k, t in rows}
    some = token_counts.token_counts(odd, path).collect()
    assert len(some) == len(ROWS) and [r["n_tokens"] for r in some if r["doc_id"] in (2, 3)] == [0, 0] and [r["over_limit"] for r in some if r["doc_id"] == 5] == [True]
    assert n_rows(token_counts.token_counts(odd.where("false"), path)) == 0


def test_languages_on_held_out_documents(spark, odd):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = QUERIES["op10_language_id"](spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) > 0
    trees = language_id.learn(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"))
    out = language_id.identify(odd, trees).collect()
    assert len(out) == len(ROWS) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (2, 3, 4))
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.learn(odd.where("false").withColumn("lang", F.lit("x")))).collect()} == {"und"}
    assert n_rows(language_id.identify(odd.where("false"), trees)) == 0


def test_toxicity_on_held_out_documents(spark, odd):
    sf = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op5_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert sum(a > b for a in toxic for b in clean) >= 0.93 * len(toxic) * len(clean)
    assert sum(s >= 0.5 for s in toxic) >= 0.6 * len(toxic) and sum(s >= 0.5 for s in clean) <= 0.02 * len(clean)
    assert sum(s >= 0.5 for s in toxic) >= 0.8 * len(toxic)
    nothing = toxicity.learn(odd, labels.where("false"))
    out = toxicity.score(odd, nothing).collect()
    assert len(out) == len(ROWS) and {r["predicted"] for r in out} == {0}
    assert n_rows(toxicity.score(odd.where("false"), nothing)) == 0


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/x?y", "https://sub.example.com/en/", "http://example.com/e", "ftp://a.net/fr/b#c", "http://a.net/fr", "no url", None, "http://badexample.com/en/a", "http://net/es/", "://", "http://x.com?a/b"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge_urls(df, url_filters.fixed_rules(spark)).collect()}
    assert got == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 1: ("sub.example.com", "/en/", "example.com/en/", "block"), 2: ("example.com", "/e", "com/", "allow"), 3: ("a.net", "/fr/b", "net/fr/", "block"),
        4: ("a.net", "/fr", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("badexample.com", "/en/a", "com/", "allow"), 8: ("net", "/es/", "net/es/", "block"), 9: ("", "", None, "allow"), 10: ("x.com", "", None, "allow"),
    }
    assert n_rows(url_filters.judge_urls(df, url_filters.fixed_rules(spark))) == len(urls) + 1
    assert n_rows(url_filters.judge_urls(df.where("false"), url_filters.fixed_rules(spark))) == 0
    part = spark.createDataFrame([("block", "a.net", "/fr/b"), ("allow", None, "/")], "verdict string, host string, path string")
    assert {r["page_id"] for r in url_filters.judge_urls(df, part).where("verdict = 'block'").collect()} == {3}
