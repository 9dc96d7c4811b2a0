"""Words by the contracts' rule, in plain Python."""

from __future__ import annotations

import random
import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(
        rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}" for _ in range(n)
    )
