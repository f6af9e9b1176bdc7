from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, ties, one very long text, signs and letters of several scripts."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ärger", "niño", "été", "x", "42", "...", "a|b", "日本", "🙂"]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    return [None, "", " \n\t ", "a", "same text here", "same text here", "SAME  text\there", long, "日本語 のテキスト", "é é ﬁ", "<|endoftext|> x", "a b  c \n d", "\x1c\x85 z"]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with exact copies, near copies, shared passages and texts of their own."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, rows = prose(40), []
    for i in range(120):
        kind = i % 6
        if kind == 0 or not rows:
            text = prose(rng.randint(3, 120))
        elif kind == 1:
            text = rng.choice(rows)[1]
        elif kind == 2:
            own = rng.choice(rows)[1].split(" ")
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        elif kind == 3:
            text = prose(20) + " " + passage + "\n" + prose(25)
        elif kind == 4:
            text = rng.choice(rows)[1][5:] + " " + prose(3)
        else:
            text = "ab" * rng.randint(20, 90) + " " + prose(rng.randint(1, 9))
        rows.append((1000 - 7 * i, text))
    return rows
