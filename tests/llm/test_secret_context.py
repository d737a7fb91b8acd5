"""Values in credential context (operator 8)."""

import pytest

from convolake.llm import secret_scan

VALUE = "K#9x!v2Q$zR7"


@pytest.mark.parametrize("lead", ["login password: ", "auth token: ", "SECRET_KEY=", "DB_PASSWORD_PROD=", "user_token_v2: ", "secretKey = ", "password is ", "token "])
def test_the_value_is_found(lead):
    text = f"x {lead}{VALUE} y"
    spans = secret_scan.guess_spans(text, secret_scan.base_spans(text), 8.0)
    assert [text[a:b] for a, _, b in spans] == [VALUE]


def test_a_value_longer_than_the_base_span_is_kept():
    text = "password=abcdef!K#9x!v2Q$z"
    base = secret_scan.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ["password=abcdef"]
    assert [text[a:b] for a, _, b in secret_scan.guess_spans(text, base, 8.0)] == ["abcdef!K#9x!v2Q$z"]
    text = "password=hunter2hunterXk9"
    assert secret_scan.guess_spans(text, secret_scan.base_spans(text), 8.0) == []


def test_other_words_are_no_credentials():
    for text in ("Author: Hemingway-1899", "AUTHORS = Hemingway-1899", "tokenizer: Hemingway-1899", "token-based Hemingway-1899"):
        assert secret_scan.guess_spans(text, [], 8.0) == []


PROSE = ["it was a secret between friends", "the secret ingredient is love", "token bucket algorithm", "a password manager stores them",
         "login failed because", "authorization required for access", "credentials provided were wrong", "password is required",
         "The Secret Garden (Burnett)", "login https://example.com/x9Qz7Kd2", "token mailto someone.else@example-mail.org", "SECRET SERVICE AGENTS",
         "a token/placeholder pair", "secret-sharing, threshold-based"]


@pytest.mark.parametrize("text", PROSE)
def test_prose_holds_no_secrets(text):
    assert secret_scan.guess_spans(text, secret_scan.base_spans(text), 8.0) == []


def test_words_of_the_corpus_are_cheap(spark):
    docs = spark.createDataFrame([("Zanthor zanthor quibbix",), ("zanthor, quibbix! ab",), (None,), ("",)], "text string").repartition(3)
    assert secret_scan.frequent_words(docs) == ["zanthor", "quibbix"] and secret_scan.frequent_words(docs, size=1) == ["zanthor"]
    ranks = secret_scan.ranks_of(["zanthor", "quibbix"])
    assert secret_scan.guess_cost("zanthorquibbix", ranks) < 2 < 8 < secret_scan.guess_cost("zanthorquibbix")
    rows = spark.createDataFrame([(1, "pwd: Zanthor-quibbix"), (2, "pwd: K#9x!v2Q$zR7"), (2, "pwd: K#9x!v2Q$zR7"), (None, None)], "doc_id int, text string")
    got = sorted((str(r.doc_id), r.n_guess) for r in secret_scan.secret_report(rows, words=secret_scan.frequent_words(docs)).collect())
    assert got == [("1", 0), ("2", 1), ("2", 1), ("None", 0)]
    assert [r.n_guess for r in secret_scan.secret_report(rows).where("doc_id = 1").collect()] == [1]


def test_base_spans_against_a_plain_search():
    """Every start is tried, the first that matches is taken, as the contract says."""
    import random
    import re
    patterns = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 6), (r"AKIA[A-Z0-9]+", 0, 0, 20), (r"[0-9a-f]+", 0, 0, 24)]
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "abcdef99", "x", "é", "-", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = []
        for kind, (pattern, flags, group, least) in enumerate(patterns):
            compiled, at = re.compile(pattern, flags), 0
            while at < len(text):
                m = compiled.match(text, at)
                if m and len(m[group]) >= least:
                    want.append((m.start(), kind, m.end()))
                at = m.end() if m else at + 1
        assert secret_scan.base_spans(text) == sorted(want), text
