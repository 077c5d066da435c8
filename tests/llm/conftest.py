"""A table of documents with every awkward case, in the shape of the driver's."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, words string, host int, bucket long, _keep string"
BENCH = "the quick study of seven rivers shows that clear water follows the old stone path to the northern sea"


def make_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "a.", "B!", "$5", "#tag"]
    texts = []
    for i in range(60):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(8, 30))) for _ in range(rng.randint(2, 6))]
        texts.append("\n".join(lines))
    passage = " ".join(rng.choices(vocab, k=70))
    texts[7] += "\n" + passage
    texts[21] = passage + " " + texts[21]
    texts[33] += " " + passage[: len(passage) // 2]
    texts[40] = texts[3]  # exact copies
    texts[41] = texts[3]
    texts[42] = texts[5].replace("w1", "W1", 1)  # a copy in other case
    texts[43] = texts[6] + " tail"
    texts[44] = texts[9] + "\n" + BENCH + "\n" + texts[10]
    texts[45] = BENCH.upper()
    texts[46] = "same line here again\n" * 20
    texts[47] = " ".join(rng.choices(vocab, k=20_000))  # very long
    texts[48] = "one"
    texts[49] = "two words"
    texts += ["", None, "  \n\t ", "\x0b\x0c", None, "", "nbsp stays one"]
    rows = [(i, t, "en", ["a", "b", "ü", None, "a", "a"][i % 6], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, "this row has no id but " + texts[11], None, "b", None))
    rows.append((None, texts[3], "en", None, 4))
    rows.append((4, texts[4], "en", "a", 4))  # a repeated row
    rows.append((4, texts[4], "en", "a", 4))
    return [(*r, 1, "clash", 2, 3, "x") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark):
    texts = [BENCH, "short item", "four words are here", None, "", "nothing like this item is in any of the texts above at all"]
    return spark.createDataFrame([*enumerate(texts), (None, BENCH), (0, BENCH)], "item_id long, text string")


@pytest.fixture(scope="session")
def sf_dir(spark, docs, items, tmp_path_factory):
    """The same documents with distinct ids, and labels: texts with junk words are bad."""
    top = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        size = rng.randint(60, 200)
        words = [rng.choice("### $$$ *** ||| <<".split()) if bad and rng.random() < 0.5 else f"word{rng.randint(0, 999)}" for _ in range(size)]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows.append((300, rows[1][1] + " and " + BENCH, "en", "s0", 0))
    rows.append((301, rows[2][1], "en", "s0", 0))  # an exact copy
    rows += [(302, None, None, None, None), (303, "", "en", "s1", 0)]
    table = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, table).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    items.write.parquet(f"{top}/benchmark.parquet")
    return top
