"""Made-up prose."""

WORDS = [f"{a}{b}{c}" for a in ("al", "be", "ko", "mi", "ru") for b in ("ra", "to", "ne", "shi") for c in ("n", "s", "")]


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))
