"""Secrets that occur more than once."""

from stratagram.llm import secrets

KEY = "q7Zx9LmP2vTr8WkY4sBnD5fGh1JcR6tVuXe3AaQw"


def places(text):
    return [(a, b) for a, b, _ in secrets.find_spans(text, secrets.Novelty())]


def all_places(text):
    return [(k, k + len(KEY)) for k in range(len(text)) if text.startswith(KEY, k)]


def test_two_example_commands():
    text = f'curl -H "Authorization: Bearer {KEY}" a\n' * 2
    assert places(text) == all_places(text) and len(all_places(text)) == 2


def test_copy_that_the_surroundings_cut():
    for gap in range(200, 300):
        text = f"the token is {KEY}" + " " * gap + f"the token is {KEY}"
        assert places(text) == all_places(text)


def test_copies_far_from_any_word():
    text = f"the token is {KEY}" + " and so on" * 100 + f" then {KEY}, and x{KEY}y"
    assert places(text) == all_places(text) and len(all_places(text)) == 3


def test_copy_beside_a_fixed_pattern():
    text = f"password={KEY}\nauthorization is {KEY}\n"
    assert [k for *_, k in secrets.find_spans(text, secrets.Novelty())] == ["assign", "novel"]
    assert KEY not in secrets.redact(text, secrets.find_spans(text, secrets.Novelty()))
