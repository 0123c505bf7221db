"""Phone numbers in lists and next to dates are candidates of their own."""

from tesserix.llm import pii


def test_numbers_in_long_runs_are_found():
    trees, cuts = pii.model()
    added = lambda t: [t[a:b] for _, a, b in pii.spans_of(t, trees, cuts)[1]]
    assert added("call 212-555-0188 / 212-555-0199 now") == ["212-555-0188", "212-555-0199"]
    assert added("on 2024-05-11 (212) 555-0188 rang") == ["(212) 555-0188"]
    assert added("ids 1234 5678 9012 3456 7890 1234") == []


def test_every_sub_run_of_seven_to_fifteen_digits_is_proposed():
    text = "x 12 (345) 6789-0123 / 45678 x"
    groups = [(2, 4, 2), (5, 9, 3), (11, 15, 4), (16, 20, 4), (23, 28, 5)]
    want = {(groups[i][0], groups[j][1]) for i in range(5) for j in range(i, 5) if 7 <= sum(n for _, _, n in groups[i : j + 1]) <= 15}
    assert {(a, b) for k, a, b in pii.candidates(text) if k == 4} == want
    assert len(list(pii.candidates("12-" * 3000))) < 15 * 3000
