"""Small tables for the tests."""

import random

ODD = [(1, None), (2, ""), (3, "one"), (4, "one"), (None, "two words"), (None, None), (5, " \t\n"), (6, "x" * 50_000), (7, "same line here\nand here\n" * 40), (7, "same line here\nand here\n" * 40), (8, " a é")]


def odd(spark):
    """Nulls, empty and long texts, repeats, and columns whose names operators use inside."""
    rows = [(d, t, "en", "s", len(t or ""), 1, 2, 3.0, "z") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, rid bigint, score double, digest string")


def none(spark):
    return odd(spark).limit(0)


def words(rng: random.Random, n: int, pool: int = 400) -> list[str]:
    return [f"w{int(rng.paretovariate(0.8)) % pool}" for _ in range(n)]


def near_copies(seed: int = 0, families: int = 8, members: int = 7, single: int = 40) -> list[tuple[int, str]]:
    """Families of texts with a few words changed, exact copies among them, and single texts that share phrases."""
    rng, out, i = random.Random(seed), [], 0
    phrase = words(rng, 12, 10_000)
    for _ in range(families):
        base = words(rng, rng.randrange(4, 160), 5000)
        for _ in range(members):
            own = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.05]) else f"c{rng.randrange(9999)}" for w in base]
            out.append((i, " ".join(own)))
            i += 1
    for _ in range(single):
        own = words(rng, rng.randrange(1, 120), 5000)
        at = rng.randrange(len(own))
        out.append((i, " ".join(own[:at] + (phrase if rng.random() < 0.5 else []) + own[at:])))
        i += 1
    rng.shuffle(out)
    return out
