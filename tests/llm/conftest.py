import random

import pytest

TOKENIZERS = "/opt/tokenizers"

#: Columns whose names operators use inside.
CLASHING = ["id", "key", "__id", "__text", "h", "seed", "batch", "row", "size", "shard", "n", "score", "component", "marks", "cell"]


@pytest.fixture(scope="session")
def prose():
    """Documents with copies, near copies, shared passages, nulls, empty, blank and very long texts."""
    r = random.Random(5)
    words = ["".join(r.choice("aeioustrnlmd") for _ in range(r.randint(2, 7))) for _ in range(300)] + ["été", "straße", "niño", "don't", "12.5"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = make(60)
    texts = [make(r.randint(3, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7].upper()]
    for k in (1, 5, 9):
        w = texts[k].split()
        if len(w) > 20:
            w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [make(40) + "\n" + passage + "\n" + make(30) for _ in range(4)]
    texts += [None, "", " \t\n ", "one", "x" * 60, "x" * 200, "日本語のテキスト" * 20, "..." * 30, make(40_000), "naïve <|endoftext|> café\r\n\x85   end  "]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture
def frame(spark):
    """(rows) -> documents with the clashing extra columns."""

    def make(rows):
        extra = ", ".join(f"{c} string" for c in CLASHING)
        data = [(i, t, "en", *("x" for _ in CLASHING)) for i, t in rows]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, {extra}")

    return make
