"""Secrets that lie behind other candidates, further segments and further lines."""

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from stratagram.llm import secrets

rng = np.random.default_rng(11)


def key(n=40, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(list(alphabet), n))


KEYS = [key() for _ in range(3)]
LINES = [key(64) for _ in range(60)]
CASES = {
    "rest of the identifier": (f'signature_for_production_build: "{KEYS[0]}"', KEYS[:1]),
    "rest of the word": (f"credentials_of_the_backup_server = {KEYS[0]}", KEYS[:1]),
    "two keys": (f"credentials: alice {KEYS[0]} and bob {KEYS[1]}", KEYS[:2]),
    "segments": ("Authorization: Bearer " + ".".join(KEYS), KEYS),
    "next line": (f"credentials:\n  user alice\n  value {KEYS[0]}\n", KEYS[:1]),
    "letters": (w := f"the passphrase is {key(32, string.ascii_letters)}", [w[-32:]]),
    "digits": (w := f"the passphrase is {key(20, string.digits)}", [w[-20:]]),
}


@pytest.mark.parametrize("name", CASES)
def test_all_in_reach(name):
    text, keys = CASES[name]
    found = [text[a:b] for a, b, _ in secrets.find_spans(text, secrets.Novelty())]
    assert set(keys) <= set(found)
    assert pc.match_substring_regex(pa.array([text]), secrets._ANY).to_pylist() == [True]


class Everything(secrets.Novelty):
    def marginal(self, before, candidate, after):
        return len(candidate)


def test_block_of_lines():
    text = "the private_key\n" + "\n".join(LINES) + "\n"
    assert [text[a:b] for a, b, _ in secrets.find_spans(text, Everything())] == LINES


def test_out_of_reach_and_compressible():
    novelty = secrets.Novelty()
    assert secrets.find_spans(f"token {'and so on ' * 6}{KEYS[0]}", novelty) == []
    assert secrets.find_spans("the token is " + "z" * 40 + " ABCDEFGHIJKLMNOPQRSTUVWXYZ", novelty) == []
    many = " ".join(f"token{i} x" for i in range(20_000))
    assert secrets.find_spans(many + " secret " + KEYS[0], novelty)[-1] == (len(many) + 8, len(many) + 48, "novel")
    assert re.fullmatch(secrets.CANDIDATE, KEYS[0])
