"""Chunk rules against a plain restatement, on hard cases, random texts and the documents."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notewright.config import Config
from notewright.functions.chunking import chunk_text, chunks, windows

HARD = {
    "front": "---\na: 1\n---\n\nIntro\n## A\nx\n## \n\n## B\n### c\n",
    "dashes": "--- a --- b --- c",
    "only": "---only",
    "late": "# T\n\n---\ntype: x\n---\n## Z",
    "word": "w" * 2000,
    "long-words": " ".join(["x" * 40] * 60),
    "bare": "## ",
    "blank": " 　\n\t",
    "exact": "a" * 1024,
    "just-over": "a " * 513,
    "odd-space": "中" * 600 + "\x1c" + "中" * 600,
    "emoji": "\U0001f600 " * 700,
}


def plain(text, size=512, keep=16):
    """One word at a time: a window closes when its length, with a space for each word, has reached the size."""
    held, out = [], []
    for word in text.split():
        held.append(word)
        if sum(len(w) + 1 for w in held) >= size:
            out.append(" ".join(held))
            held = held[-keep:]
    return out + ([" ".join(held)] if held else [])


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(list(HARD.items()), "source string, content string")
    rows = chunks(files).orderBy("source", "section", "window").collect()
    return {k: [r.text for r in rows if r.source == k] for k in HARD}, rows


def test_hard_cases(found):
    texts, rows = found
    assert texts["front"] == ["Intro", "## A\nx", "## ", "## B\n### c"]
    assert texts["dashes"] == ["b --- c"]
    assert texts["only"] == ["---only"]
    assert texts["late"] == ["# T\n\n---\ntype: x\n---", "## Z"]
    assert texts["word"] == ["w" * 2000] * 2
    assert texts["bare"] == ["##"]
    assert texts["blank"] == []
    assert texts["exact"] == ["a" * 1024]
    for k in ("long-words", "just-over", "odd-space", "emoji"):
        assert texts[k] == plain(HARD[k])
    assert all(r.chunk_id == hashlib.md5(r.text.encode()).hexdigest() for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=120), st.integers(5, 200), st.integers(1, 20))
def test_windows_are_the_plain_ones(lengths, size, keep):
    words = [chr(97 + i % 26) * n for i, n in enumerate(lengths)]
    got = [" ".join(words[a:b]) for a, b in windows(np.array(lengths), size, keep)]
    assert got == plain(" ".join(words), size, keep)


def test_short_texts_keep_their_lines():
    assert chunk_text("a\nb", 512, 16) == ["a\nb"]


def test_config():
    assert Config().overlap_words == 16 and Config(overlap=65).overlap_words == 17
    with pytest.raises(ValueError):
        Config(overlap=0)
    made = Config.from_environment({"CHUNK_SIZE": "100", "EXCLUDE_DIRS": "", "METRIC": "dot"})
    assert (made.chunk_size, made.exclude, made.metric) == (100, (), "dot")
