import random

import pytest

WORDS = "the of and with river stone cloud winter orange little window garden summer yellow paper silver mountain kitchen letter bridge".split()


def prose(draw, n):
    out, line = [], []
    for _ in range(n):
        line.append(draw.choice(WORDS) + draw.choice(["", "s", "ed", "ing", "er"]))
        if draw.random() < 0.08:
            out.append(" ".join(line) + ".")
            line = []
    return "\n".join([*out, " ".join(line)])


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty ones, copies, near copies, a very long one and odd characters."""
    draw = random.Random(11)
    found = [prose(draw, draw.randint(5, 300)) for _ in range(60)]
    found += [None, "", "   \n\t ", "one", "two words", "ÀÉÎ ß 日本語 🎉 mixed", "a" * 30_000, prose(draw, 12_000)]
    found += [found[0], found[0], found[1].replace("river", "rivet", 1), found[2] + " more"]
    return found


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, ["en", "de", None][k % 3], f"src{k % 4}", None if t is None else len(t), k, "x", k, "y", 0.5) for k, t in enumerate(texts)]
    # columns whose names the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long, node string, gone long, gone_lines string, score double")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
