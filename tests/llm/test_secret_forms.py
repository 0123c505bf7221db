"""Annotated assignments, tabs and joined literals in the secret lexer."""

import pytest

from tesserix.llm import secrets


def found(text):
    return [text[a:b] for a, _, b in secrets.spans_of(text)[1]]


@pytest.mark.parametrize("text, want", [
    ('db_pwd: str = "aB3$xK9!mQ"', ["aB3$xK9!mQ"]),
    ('const authKey: string = "aB3$xK9!mQ"', ["aB3$xK9!mQ"]),
    ('db_pwd: Optional[str] = "aB3$xK9!mQ"', ["aB3$xK9!mQ"]),
    ('signingKey?: string | null = "aB3$xK9!mQ"', ["aB3$xK9!mQ"]),
    ('password: str = "aB3$xK9!mQ"', ["aB3$xK9!mQ"]),
    ('db_pwd\t=\t"aB3$xK9!mQ"', ["aB3$xK9!mQ"]),
    ('db_pwd = "abc12" + "XY34z"', ["abc12", "XY34z"]),
    ('db_pwd = "abc12"\t+\t"XY34z"', ["abc12", "XY34z"]),
    ('a: str = "abc12"\nb: str = "XY34z"\ndb_pwd = a + b', ["abc12", "XY34z"]),
    ('title: str = "aB3$xK9!mQ"\ndb_pwd: str = load()', []),
    ('title: str = "abc12" + "XY34z"', []),
    ('db_pwd = "ab" + "c"', []),
])
def test_forms(text, want):
    assert found(text) == want


def test_long_lines_are_read_in_bounded_time():
    assert found("a: " + "b<" * 20_000 + "=" + "k: x|y|" * 10_000 + "=1") == []
