import random

import pytest

EN = "the of and to in that is was for with on are this be by not have from they which one had word but what".split()
FR = "le la les de des et en un une que qui dans pour pas sur avec est sont nous vous été très même où".split()


def prose(seed, size, words=EN, lines=False):
    rng = random.Random(seed)
    made = [rng.choice(words) + rng.choice(["", "", "ing", "er", "a", "o"]) + str(rng.randrange(40)) for _ in range(size)]
    return "".join(w + ("\n" if lines and rng.random() < 0.1 else " ") for w in made).strip()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empty, short and very long texts, repeated rows."""
    base, shared, line = prose(1, 120), prose(2, 50), "A line that  Repeats."
    rows = [(1, base), (2, base), (3, base.replace(" ", "\n", 3)), (4, None), (5, ""), (6, "word"), (7, "Word"), (8, "  \t ")]
    words = base.split()
    for k in range(12):  # near copies that drift away from each other
        words = [*words[: 5 + 9 * k], f"new{k}", *words[5 + 9 * k :]]
        rows.append((20 + k, " ".join(words)))
    rows += [(40 + k, prose(50 + k, 60 + k) + " " + shared + " " + prose(90 + k, 30)) for k in range(8)]
    rows += [(60 + k, f"{prose(150 + k, 20)}\n{line}\n\n{prose(190 + k, 9)}\n {line.upper()} ") for k in range(14)]
    rows += [(80, prose(3, 9000, lines=True)), (81, "ab " * 3000), (82, "é" * 2000), (83, prose(3, 200)), (84, prose(3, 200))]
    rows += [(85, prose(7, 80)), (85, prose(7, 80)), (86, prose(8, 40)), (86, prose(9, 40)), (None, base), (None, "alone here")]
    return rows


CLASHING = ["base", "found", "share", "gone", "copies", "spans", "w", "n", "id", "class", "doc", "key", "a.b", "a`b", "__key_a", "__x0", "task", "high"]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table with extra columns, some named like those that operators add or make up."""
    more = [f"v{i}" for i in range(len(CLASHING))]
    rows = [(d, t, "en", f"s{i % 3}", i, True, "x", *more) for i, (d, t) in enumerate(corpus)]
    names = ["doc_id", "text", "lang", "source", "label", "kept", "a b", *CLASHING]
    kinds = ["long", "string", "string", "string", "int", "boolean", "string", *["string"] * len(CLASHING)]
    schema = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
