import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, edits, shared passages, nulls, blanks, one very long text and an unsplit one."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage = text(120), text(40)
    rows = [(1, base), (2, base), (9, base.upper())]
    for i in range(10, 22):
        words = base.split()
        for _ in range(rnd.randint(1, 6)):
            words[rnd.randrange(len(words))] = "edit%d" % i
        rows.append((i, " ".join(words)))
    rows += [(30 + i, text(30) + "\n" + passage + "\t" + text(20)) for i in range(5)]
    rows += [(40, None), (41, ""), (42, " \n "), (43, "one"), (44, "one"), (45, "a b c"), (46, "A B C")]
    rows += [(50, text(6000)), (51, "x" * 5000), (52, ("ab" * 40 + " ") * 300), (-7, text(50)), (60, passage)]
    rows += [(70, "same same " * 40), (71, "same same " * 41), (1, base)]
    return rows
