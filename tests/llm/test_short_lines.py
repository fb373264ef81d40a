"""Line dedup of every line that is not empty, against brute force."""

from __future__ import annotations

from llm_fixtures import documents, odd, prose  # noqa: F401
from test_text_operators import brute_lines, by_id

from rosterlake.llm import substring_lines


def test_short_lines_equal_brute_force(documents, odd):
    rows = [*odd, *((20 + i, f"les.\n{'and' if i % 2 else 'AND '} ornd.\n\nown {i}\nles.") for i in range(30))]
    got = substring_lines.remove_repeated_lines(documents(rows))
    assert by_id(got, "n_bytes", "n_units", "n_removed_units", "kept") == brute_lines(rows)
    got = substring_lines.remove_repeated_lines(documents(rows), min_chars=20)
    assert by_id(got, "n_bytes", "n_units", "n_removed_units", "kept") == brute_lines(rows, 20)
