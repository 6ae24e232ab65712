"""Novel spans against a plain scan, planted keys, and very long texts."""

import re
import string
import time

import numpy as np

from stratagram.llm import secrets
from stratagram.llm.common import table

rng = np.random.default_rng(5)
LETTERS = string.ascii_letters + string.digits


def key(n):
    return "".join(rng.choice(list(LETTERS), n))


def plain_novel(text, novelty):
    """Every candidate, reach by reach, with loops only."""
    taken = secrets.base_spans(text)
    candidates = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text, re.ASCII)]
    words = [m.end() for m in secrets.SENSITIVE.finditer(text)]
    free = lambda a, b, spans: not any(a < y and x < b for x, y, _ in spans)
    out, done = [], 0
    for end in words:
        at = max(done, end)
        limit = at + secrets.REACH
        while True:
            # A word inside a run of characters leaves the rest of the run as a candidate.
            rest = [(max(a, at), b) for a, b in candidates if b - max(a, at) >= 16]
            if not rest or rest[0][0] > limit:
                break
            a, b = rest[0]
            limit += secrets.JOINT.match(text, b).end() - a
            at = done = b
            if free(a, b, taken) and novelty.measure(text, a, b) >= secrets.NOVEL * (b - a):
                out.append((a, b, "novel"))
    strings, held, at, k = {text[a:b] for a, b, _ in out}, taken + out, 0, 0
    found = list(out)
    while k < len(text):
        here = max((s for s in strings if text.startswith(s, k)), key=len, default=None)
        if here is None:
            k += 1
            continue
        if free(k, k + len(here), held):
            found.append((k, k + len(here), "novel"))
        k += len(here)
    return sorted(found)


def texts():
    out = []
    for _ in range(60):
        words = []
        for _ in range(rng.integers(1, 60)):
            words.append(rng.choice(["token", "secret", "and", "so", "on", "bearer", "password=", "signature_of", "\n", ".", "configuration", key(20), key(40), "x" * 24, "0" * 30, "deadbeef" * 4]))
        if rng.random() < 0.4:
            words += words[:5]
        out.append(" ".join(words))
    return out


def test_novel_spans_are_those_of_a_plain_scan():
    novelty = secrets.Novelty()
    found = 0
    for text in texts():
        want = plain_novel(text, novelty)
        assert sorted(s for s in secrets.find_spans(text, novelty) if s[2] == "novel") == want
        found += len(want)
    assert found > 50


def test_given_documents(spark, sf):
    novelty = secrets.Novelty()
    for r in table(spark, sf, "documents").select("text").collect():
        assert sorted(s for s in secrets.find_spans(r["text"] or "", novelty) if s[2] == "novel") == plain_novel(r["text"] or "", novelty)


def test_recall_and_precision_on_planted_keys():
    novelty, hits, false = secrets.Novelty(), 0, 0
    prose = "the configuration of this server reads the environment and the request returns a response with the content type ".split()
    for _ in range(200):
        secret = key(int(rng.integers(20, 60)))
        text = " ".join(rng.choice(prose, 30)) + f" the access key is {secret} " + " ".join(rng.choice(prose, 30))
        hits += any(text[a:b] == secret for a, b, _ in secrets.find_spans(text, novelty))
        tame = " ".join(rng.choice(prose, 30)) + " the token is " + "".join(rng.choice(prose, 4)) + "_" + "".join(rng.choice(prose, 3))
        false += bool(secrets.find_spans(tame, novelty))
    assert hits >= 198 and false <= 10


def test_a_megabyte_of_sensitive_words():
    novelty = secrets.Novelty()
    for text in ("token ab " * 110_000, "token=a " * 125_000 + key(40), "passwd" * 170_000):
        began = time.time()
        secrets.find_spans(text, novelty)
        assert time.time() - began < 3


def test_a_megabyte_of_distinct_keys():
    novelty = secrets.Novelty()
    text = "".join(f"the token is {key(24)}\n" for _ in range(20_000))
    began = time.time()
    spans = secrets.find_spans(text, novelty)
    assert len(spans) >= 19_900 and time.time() - began < 20
