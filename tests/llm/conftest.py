"""Small corpora with hard rows: nulls, empty and long texts, copies, repeated rows, other scripts."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    long, shared, passage = words(rng, 3000), words(rng, 40), words(rng, 25)
    texts = [None, "", "   \n\t ", "one", "One two", "a b c", long, long + " tail", shared, shared.upper(), shared, "\u00a0 \u2003x", "🙂 émoji text"]
    texts += [f"{words(rng, rng.randint(3, 60))} {passage} {words(rng, rng.randint(0, 30))}" for _ in range(12)]
    texts += ["ab " * 60, "x" * 700, ("line of text that repeats\n" * 15).strip()]
    base = words(rng, 90).split()
    for _ in range(8):
        t = base[:]
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "zz"
        texts.append(" ".join(t))
    texts += [words(rng, rng.randint(1, 80)) for _ in range(30)]
    sources = [None, "a", "b", "é", "hot", "hot", "hot"]
    rows = [(i * 3, t, "en", sources[i % len(sources)], 0, "x") for i, t in enumerate(texts)]
    rows.append(rows[8])  # a row that is there twice
    rows.append((None, shared, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A folder of tables made of the given rows."""
    def make(name, **tables):
        top = tmp_path_factory.mktemp(name)
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{top}/{table}.parquet")
        return str(top)
    return make


@pytest.fixture(scope="session")
def docs_rows():
    return corpus()


@pytest.fixture(scope="session")
def docs_dir(folder, docs_rows):
    bench = [(1, docs_rows[13][1]), (2, "one two"), (3, None), (4, ""), (None, "a b c"), (10, docs_rows[13][1]), (5, " ".join(docs_rows[20][1].split()[:30]))]
    labels = [(r[0], 1, int(i % 4 == 0)) for i, r in enumerate(docs_rows) if r[0] is not None and i % 2 == 0] + [(3, None, None)]
    return folder("docs", documents=(docs_rows, DOCS), benchmark=(bench, "item_id long, text string"), labels=(labels, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="session")
def empty_dir(folder):
    return folder("empty", documents=([], DOCS), benchmark=([], "item_id long, text string"), labels=([], "doc_id long, quality int, toxic int"),
                  pages=([], "page_id long, url string, html string"), embeddings=([], "vec_id long, embedding array<float>, label int"))
