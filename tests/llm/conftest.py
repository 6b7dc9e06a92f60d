import pytest

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % (1 << 32)
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % (1 << 32)
        out.append(WORDS[x >> 16 & 63 if (x >> 16 & 63) < len(WORDS) else (x >> 22) % len(WORDS)] + WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text, lang, source: nulls, empty and long texts, copies, near copies, equal rows, equal ids."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "de", "a"), (4, None, "en", None), (5, "", None, "b"), (6, "  \n\t ", "de", "c"),
        (7, prose(2, 3000), "fr", "a"), (8, prose(3, 40) + " " + base[50:400] + " " + prose(4, 30), "en", "d"), (9, "a", "en", "e"), (9, "b", "en", "e"), (10, "same row", "en", "e"), (10, "same row", "en", "e"),
        (None, "no id " + prose(5, 30), "en", "a"), (11, "ÉÀ é ünï 漢字 " + prose(6, 20), "fr", "f"), (12, "x" * 700, "en", "a"), (13, "xy" * 300, "en", "a"), (14, "One two THREE", "en", "a"), (15, "one two three", "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edges):
    """The same rows with columns of the operators' own names."""
    from pyspark.sql import functions as F

    names = ["__id", "__h", "__sig", "__source", "__rank", "source_size", "copy", "node", "root", "id", "own", "own_text", "words", "h", "i", "w", "ids", "fp", "k", "d", "th", "size", "rate", "target", "score", "predicted", "copies", "row", "gone", "kept", "sig", "n", "v", "asked"]
    return edges.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
