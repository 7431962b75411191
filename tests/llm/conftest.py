import random

import pytest

_WORDS = "the of and to in river stone amber quiet field walks under bright morning table window paper seven green".split()


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, periodic stretches and edge cases."""
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(_WORDS) + str(r.randrange(40)) for _ in range(n))
    passages = [prose(60) for _ in range(3)]
    out = [prose(r.randrange(5, 120)) for _ in range(40)]
    out += [f"{prose(20)} {p} {prose(15)}" for p in passages for _ in range(3)]
    base = prose(200)
    for i in range(8):
        words = base.split()
        words[20 * i] = "changed"
        out.append(" ".join(words))
    out += [base, base, "", "   \n\t", "a", "word " * 400, "ab" * 500, "é" * 250 + "ß", "Ünïcode Text mit Wörtern — und mehr… " * 3, "x" * 199, "x" * 200]
    return out


@pytest.fixture
def make(spark, texts):
    """Documents with clashing extra columns, a null text, a null id and a repeated row."""

    def build(rows=None):
        rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", len(t)) for i, t in enumerate(texts)] if rows is None else rows
        extra = [(900, None, None, None, None), (None, "no id here at all", "en", "src0", 17), rows[0]] if rows else []
        df = spark.createDataFrame([(*x, "e", 0) for x in [*rows, *extra]], "doc_id long, text string, lang string, source string, n_chars long, fp string, n long")
        return df.repartition(3)

    return build
