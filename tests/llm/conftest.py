import random

import pytest


@pytest.fixture(scope="session")
def words():
    """A maker of random words from a vocabulary that no two documents share by chance."""
    rng = random.Random(11)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    return lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
