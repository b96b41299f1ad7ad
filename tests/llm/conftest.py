import os
import random
from pathlib import Path

import pytest

# workers import functions that tests hand over
os.environ["PYTHONPATH"] = f"{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}"

ALPHABET = "the of and to in re er on an ti es en at nd or tion ing ou é ñ ß".split()


def invented(seed, n):
    """A text of n invented words."""
    r = random.Random(seed)
    return " ".join("".join(r.choice(ALPHABET) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows, extra=()):
    """A documents table with columns that clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, record string, shard int, kept boolean, score double, bucket long, target long, wanted_id long, id string, digest string, class string, root long, block int, term string"
    full = [(i, t, "en", "s", len(t or ""), "r", 1, True, 0.5, 7, i, i, "i", "d", "c", 5, 3, "t", *extra) for i, t in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and very long texts, copies, near copies, shared passages, repeated rows and a null id."""
    base = [invented(k, 60) for k in range(12)]
    passage = invented(99, 45)
    near = base[0].split()
    near[30] = "changed"
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [
        (20, base[3]),
        (21, base[3]),
        (22, " ".join(near)),
        (23, None),
        (24, ""),
        (25, " \t\n "),
        (26, "one"),
        (27, "ONE"),
        (28, "a b c"),
        (29, base[4] + " " + passage),
        (30, passage + "  " + base[5]),
        (31, passage + "\n" + passage),
        (32, invented(7777, 20_000)),
        (33, "«»… 漢字 🎉 ▁ \x01"),
        (34, "x" * 50_000),
        (35, "!!! ... 123"),
        (None, "a text without id"),
        (40, "twice " + base[6]),
        (40, "twice " + base[6]),
    ]
    return rows
