"""Nesting, sections, rebinding and hostile texts in the secret lexer, and its spans against a plain rule."""

import random
import time

import pytest

from tesserix.llm import secrets

KEY = "Zx91kfLq88PPa"


def found(text):
    return [text[a:b] for a, _, b in secrets.spans_of(text)[1]]


@pytest.mark.parametrize("text, want", [
    ('{"db": {"credentials": {"value": "KEY", "host": "db.internal"}}}', [KEY]),
    ("database:\n  credentials:\n    user: bob\n    value: KEY\nother:\n  value: Yx91kfLq88PPb\n", [KEY]),
    ("[auth]\nkey = KEY\n[paths]\nkey = Yx91kfLq88PPb\n", [KEY]),
    ("seed = 'KEY'\nseed = load()\ndb_pwd = seed\n", []),
    ("seed = 'KEY'\nother = seed\ndb_pwd = other\n", [KEY]),
    ("<dbPassword>KEY</dbPassword><port>8080</port>", [KEY]),
    ('auth_tokens = ["KEY", "Yx91kfLq88PPa"]', [KEY, "Yx91kfLq88PPa"]),
    ('private_key = """KEY\nline two 22"""', [KEY + "\nline two 22"]),
    ("export AUTH_PWD=KEY", [KEY]), ("pwd = b'KEY'", [KEY]), ("db_pwd: KEY", [KEY]),
    ('auth_pwd = "KEY" and prose with. words 12.34.56.78 after', [KEY]),
    ("the token of the day is a ring = gold and name: bob", []), ("password: remembering.", []),
])
def test_syntax(text, want):
    assert found(text.replace("KEY", KEY)) == want


def test_doubling_lines_take_no_time():
    text = f"a0 = '{KEY}'\n" + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(60)) + "db_pwd = a60"
    began = time.perf_counter()
    assert found(text) == [KEY]
    assert time.perf_counter() - began < 0.1


def test_many_spans_take_time_in_proportion():
    text = "".join(f"token = 'abcdefabcdef{i:016x}'\npwd{i} = '{KEY}{i}'\n" for i in range(16_000))
    assert len(text) > 1_000_000
    began = time.perf_counter()
    base, more = secrets.spans_of(text)
    assert len(more) == 16_000 and len(base) == 32_000
    assert time.perf_counter() - began < 10


def test_joined_scores_equal_those_of_the_joined_text():
    r = random.Random(3)
    for _ in range(200):
        parts = ["".join(r.choice("aB3$xK9 mQ") for _ in range(r.randint(0, 9))) for _ in range(4)]
        value = secrets.Value()
        for p in parts:
            value = value.joined(secrets.Value(p))
        if not any(secrets.Value(p).placeholder for p in parts):
            assert abs(value.score() - secrets.literal_score("".join(parts))) < 1e-9


def test_flat_assignments_against_a_plain_rule():
    """Plain lines of one assignment each: a literal is found if the names it reaches are sensitive and it scores."""
    r = random.Random(9)
    names = ["db_pwd", "colour", "auth_key", "title", "signing_key", "x"]
    for _ in range(100):
        lines, bound, reach, spans, at = [], {}, {}, {}, 0
        for i in range(12):
            name, source = r.choice(names), r.choice(["literal", "name", "call"])
            if source == "literal":
                value, new = f"'k{i}Qz{r.randrange(10**9)}'", i
            elif source == "name":
                other = r.choice(names)
                value, new = other, bound.get(other)
            else:
                value, new = "load()", None
            line = f"{name} = {value}"
            if source == "literal":
                spans[i] = (at + len(name) + 4, at + len(line) - 1)
            bound[name] = new
            if new is not None:
                reach[new] = max(reach.get(new, 0), secrets.name_score(name))
            lines.append(line)
            at += len(line) + 1
        text = "\n".join(lines)
        want = sorted(spans[i] for i in spans if reach.get(i, 0) * secrets.literal_score(text[spans[i][0] : spans[i][1]]) >= secrets.SCORE)
        assert [(a, b) for a, b, _ in secrets.lexed(text)] == want
