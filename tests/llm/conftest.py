import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _extra string, row string"


def _corpus():
    rng = random.Random(11)
    sounds = {"en": "the of th ing er an re on at".split(), "de": "der die ung sch ei ch en ü ge".split()}
    vocabulary = {k: ["".join(rng.choices(v, k=rng.randint(1, 4))) for _ in range(400)] for k, v in sounds.items()}
    docs = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(rng.choices(vocabulary[lang], k=rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.append("a line that many of the documents here have in common")
        docs.append([i, "\n".join(lines), lang, None if i % 13 == 0 else f"s{i % 5}"])
    near = docs[3][1].split(" ")
    for i in range(60, 66):
        changed = list(near)
        changed[i % len(near)] = f"other{i}"
        docs.append([i, " ".join(changed), "en", "s1"])
    docs += [[66, docs[4][1], "en", "s2"], [67, None, "en", "s1"], [68, "", None, "s1"], [69, " \n\t\n", "de", None], [70, "12 34 !!", None, "s1"]]
    docs += [[71, "  two  spaces\r\n\x0b▁ 😀 ﬁ <|endoftext|>\n\n\n", "en", "s3"], [72, "x" * 20_000, None, "s3"], [73, " ".join(rng.choices(vocabulary["en"], k=4000)), "en", "s3"]]
    docs += [docs[5][:], [None, "a text without an id", "en", "s1"], [5, "another text of a known id", "en", "s1"]]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y") for i, t, lang, s in docs]


@pytest.fixture(scope="session")
def corpus():
    return _corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sf_dir(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty_dir(empty, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)
