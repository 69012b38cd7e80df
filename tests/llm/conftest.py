import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long, shard int, ids string, "
    "offset string, tag string, n_words string, n_entities string, _row string"
)


def awkward_rows():
    """NULLs, empty and long texts, ties, repeated rows, copies and shared passages."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本", "don't", "x\x1cy", "a\xa0b", "The,", "🙂"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, copy = text(40), text(80)
    rows = [(i, text(rnd.randrange(60, 140)) + "\n" + text(8)) for i in range(60)]
    rows += [(100 + i, text(20) + " " + passage + "\n\t" + text(20)) for i in range(20)]
    rows += [(200 + i, copy + (f" z{i}" if i % 2 else "")) for i in range(12)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (None, copy), (None, None), (303, "one"), (304, "two words"), (305, text(9000))]
    rows += [(306, "a " * 70), (306, "a " * 70), (200, copy), (307, text(60)), (307, text(60)), (308, "x\r\ny\x0bz " + passage)]
    rows += [(309, "mail jo.doe1@mail2.example.com, JO.DOE1@MAIL2.EXAMPLE.COM or +1 (743) 555-3824, +1 743 555 3824\n70.23.22.57 " + text(60))]
    rows += [(310, 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" password=e3b3ed3cc8548923d6 Mrs. Erika Muster ' + text(60))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, None if n % 17 == 0 else "en", None if n % 19 == 0 else f"s{n % 2}", len(t or ""), *["x", 1, 1, *["x"] * 6]) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3).persist()
