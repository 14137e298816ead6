"""Very long and hostile inputs: runs of white space, nested and broken markup."""

import time

import pytest
from cases import docs
from test_texts import check_pieces, digests_by_hand, read_back, said

from dialwise.llm import chat, html, packing

RUNS = [
    " " * 3_000_000, "\n" * 3_000_000, "\t" * 3_000_000, "word" + " \n" * 1_500_000 + "end",
    "a" + " " * 999_999 + "b" + "\t" * packing.LONG_RUN + "c  d", "x" * 1_000_000,
]


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n", "　", "\x1c"])
@pytest.mark.parametrize("more", [-1, 0, 1])
def test_ids_of_long_runs_are_those_of_the_library(space, more):
    run = space * (packing.LONG_RUN + more)
    library = packing._library(packing.VOCABULARY)
    for text in (run, f"a{run}b", f"{run}x y  z<|endoftext|>", f"q  r{run}"):
        assert packing.token_ids(text) == library.encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed_and_formatted(spark):
    rows = list(enumerate(RUNS, 1))
    check_pieces(packing.pack(docs(spark, rows)).collect(), rows)
    turns = [(1, i, ["user", "assistant"][i % 2], text) for i, text in enumerate(RUNS[:4])]
    assert read_back(chat.format_conversations(said(spark, turns))) == digests_by_hand(turns)


N = 200_000
DEEP = {
    "nested": ("<div>a b" * N, " ".join(["a b"] * N)),
    "unclosed tags": ("x " + "<a " * N, None),
    "stray ends": ("<b>" * N + "x</i>" * N, "x" * N),
    "quotes": ('y <a ">" ' * (N // 2) + '"', None),
    "blocks in inline": ("<div>" + "<b>" * N + "<p>x</p>" * N, " ".join(["x"] * N)),
    "script without end": ("z<script>" + "</script " * N, "z"),
    "one long name": ("w " + "<a" * (N * 2), None),
    "classes": ("".join(f"<div class=k{'abc'[i % 3]}>t" for i in range(N)), " ".join(["t"] * N)),
    "attributes": ("<div " + 'id="' * N + "\">x", None),
    "lists": ("<ul><li>v" * (N // 2), " ".join(["v"] * (N // 2))),
    "siblings": ("<div>s</div>" * N, " ".join(["s"] * N)),
}


@pytest.mark.parametrize("name", DEEP)
def test_markup_of_any_depth_ends_in_seconds(name):
    page, want = DEEP[name]
    start = time.process_time()
    text = html.main_text(page, None)
    assert time.process_time() - start < 30
    if want is not None:
        # Of nested containers, the innermost one that holds nearly all text.
        assert text == want or name in ("nested", "classes") and text in want and len(text) > 0.949 * len(want)


@pytest.mark.parametrize("name", ["nested", "unclosed tags", "quotes", "stray ends"])
def test_time_grows_in_proportion(name):
    page = DEEP[name][0]

    def seconds(part):
        start = time.process_time()
        html.main_text(part, None)
        return time.process_time() - start

    seconds(page[:10_000])
    small, large = seconds(page[: len(page) // 8]), seconds(page)
    assert large < 8 * small * 4 + 0.5
