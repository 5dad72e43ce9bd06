import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, fp string"

HARD = [
    None,
    "",
    " \n\t ",
    "word",
    "a b",
    "a" * 50_000,
    "same words here " * 2_000,
    "mail a@b.c_d@e.f or x@y.z. ip 1.2.3.4.5.6.7.8 and 0001.002.3.255 not 256.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (555) 123-4567, +12",
    "é😀 a.b+c@x-y.co.uk! iban GB82 WEST 1234 5698 7654 32 ssn 123-45-6789",
    "<|endoftext|> hi<|endoftext|>",
    "  two  spaces\n\n x \t y z   don't 'll've ²½三 \u00a0 ",
    "One line that is long enough to be looked at here.\nshort\nOne line that is long enough to be looked at here.",
    "User 17 logged in from host alpha at 10:01 on monday.\nUser 18 logged in from host beta at 10:02 on monday.",
    "User 99 logged in from host gamma at 11:59 on monday.",
    "x" + "\u0301" * 10 + "#*$%&|<>",
]


@pytest.fixture(scope="session")
def hard_docs(spark):
    """The smallest documents, hostile texts, repeated rows, null ids and sources, columns with clashing names."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "k", "s", "f") for r in given]
    rows += [(1000 + i, t, None, None if i % 3 else "src0", None, None, None, None) for i, t in enumerate(HARD)]
    rows += [rows[5], rows[5], (None, HARD[8], None, None, None, None, None, None), (None, "only here, without an id", None, "z", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
