import random

import pyarrow.dataset as ds
import pytest

SF = "/root/testdata/sf0.001"
#: Names that the operators use for working columns.
CLASHES = {c: "x" for c in ("_row", "_rest", "part", "key", "bucket", "mark", "row", "node", "label", "base", "open", "seeds", "kept", "rule", "n", "found", "start", "ids")}


def odd_texts():
    """Null, empty, blank, very long, tied and repeated texts, and some prose."""
    rng = random.Random(5)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()
    prose = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 160))) for _ in range(25)]
    long = " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(12_000))
    near = [prose[k] + " and more words at the end" for k in range(5)]
    odd = [None, "", " \n\t ", "one", "two words", "y " * 700, "z" * 3000, "é字🙂 é字🙂\x0b\x0cé", prose[3], prose[3], prose[4] + "\n" + prose[5]]
    return prose + near + odd + [long, long + " tail", "He said 'tis   so", "A B C D E F", "a b c d e f"]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with a null id, a shared id, equal rows and further columns of clashing names."""
    texts = odd_texts()
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, texts[1]), (None, None), (7, texts[12]), (8, texts[8]), (3, texts[3])]
    frame = spark.createDataFrame([(i, t, *CLASHES.values()) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    return frame.repartition(3), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


@pytest.fixture(scope="session")
def documents():
    table = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


def sorted_rows(frame, *columns):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key)


def sort_plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
