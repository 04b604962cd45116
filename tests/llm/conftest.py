import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 23))
    return " ".join(out)


def awkward() -> list[tuple]:
    """Rows with nulls, empty, very long and repeated texts, ties, near copies and shared passages."""
    a, b, passage = prose(1, 120), prose(2, 90), prose(3, 60)
    near = a.split()
    near[60] = "changed"
    rows = [
        (5, a), (3, a), (3, a), (9, " ".join(near)), (None, a), (None, None), (7, None), (8, ""), (11, "   \n\t"), (12, "word"), (13, "WORD"),
        (14, b + " " + passage), (15, passage + " " + prose(4, 50)), (16, prose(5, 40) + " " + passage + "\n" + prose(6, 20)),
        (17, (prose(7, 40) + "\n") * 3), (18, "x" * 30_000), (19, prose(8, 12_000)), (20, "A shared line here\nother\n  a SHARED line here\t"),
        (21, "a shared line here"), (22, "short\nshort"), (23, "short"), (24, "\n\n\n"), (25, "É à ça  où çà été́\nça où été là-bas"),
        (26, "mail a.b@c.de, a@b.c@d.e and 1.2.3.4 or 1.2.3.4.5.6.7.8, 999.1.1.1; 4111 1111 1111 1111 +1 (555) 010-9999 \U0001f389 x@y.z"),
        (27, "<|endoftext|> it's 'S they'll  \n\t 漢字 12³ <|startoftext|>x"), (28, " ".join(["same"] * 200)), (2, a.upper()),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as documents with extra columns whose names the operators use themselves."""
    full = [(d, t, "x", 1, "y", True, "e") for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, row string, n_words int, runs string, keep boolean, lang string").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
