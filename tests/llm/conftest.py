import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, source string, key long, hash long, kind int, label int, rate double, shard int, _group string, `a.b` int, " + ", ".join(f"{x} int" for x in "copy n_copies _sha sha _gone gone _id id _label row node _row _key _text doc".split())


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ß", "x" * 200, "ABC", "a\x1cb"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(160), say(70)
    out = [None, "", " \t\n", "One", "one", "ONE", "É", "é", "a b", say(49), base, base, base.upper(), base.lower()]
    for edits in (1, 2, 3, 5, 8):
        for _ in range(3):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    out += [say(20) + " " + passage + " " + say(30) for _ in range(8)] + [passage, passage + "\n\n" + passage, passage.replace(" ", "  "), "same " * 400, "same " * 300, say(6000), say(120)]
    return out


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, rows that repeat an id or all of it."""
    rows = list(enumerate(texts()))
    random.Random(5).shuffle(rows)
    one = rows[7]
    return rows + [one, one, (rows[3][0], rows[11][1]), (rows[4][0], "another text under an id that is there"), (None, "without an id"), (None, rows[9][1]), (10_000, None)]


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The same as a table, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 5 else None, 1, 2, 3, 4, 0.5, 6, "g", 7, *range(100, 115)) for i, t in documents], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
