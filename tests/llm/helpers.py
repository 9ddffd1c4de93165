"""Invented text for the tests."""
import random

SYLLABLES = ["ka", "lo", "mi", "ter", "un", "sa", "ve", "rin", "do", "pe"]
COMMON = ["the", "and", "of", "is", "that", "with"]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(COMMON) if rng.random() < 0.3 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int, per_line: int = 9) -> str:
    w = words(rng, n)
    return "\n".join(" ".join(w[i:i + per_line]) + "." for i in range(0, n, per_line))


#: Names that the operators use inside, as a caller's own columns.
CLASHING = ("node", "bucket", "key", "range", "first", "row", "k1", "position", "score", "kept", "root", "set", "places", "size")
