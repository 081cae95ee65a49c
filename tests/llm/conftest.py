import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n_tokens string, key string, piece int"


def prose(rng: random.Random, n: int, stem: str = "") -> str:
    return " ".join(stem + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls, empties, a long text, near and exact copies, repeated rows and ids; clashing columns."""
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    near = base[0].split(" ")
    near[60] = "changed"
    texts = [*base, base[1], base[1], " ".join(near), None, "", " \n ", "one two", "one two", prose(rng, 9000), "Zeile eins\nZeile zwei\nZeile eins", "é́ 😀 中文 <|endoftext|> </s> 'll 've"]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(3, base[3]), (None, base[4]), (None, "only here without an id"), (None, None)]
    return [(i, t, None if k % 7 == 0 else "en", "s", None if t is None else len(t), k, "x", "k", 1) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain_docs():
    return [(r[0], r[1]) for r in rows()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, docs, tmp_path_factory):
    """A folder of tables as the queries read them."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i != 20), 0) for i in range(25)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    turns = [(1, 0, "system", "be brief"), *[(1, t, ("user", "assistant")[t % 2 == 0], f"text {t} " * 60) for t in range(1, 9)], (2, 0, "user", None), (2, 0, "user", None), (3, 1, None, "<|end|>~1[/INST]"), (3, 2, "assistant", "<|assistant|>~0~"), (None, 0, "assistant", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def no_tables(spark, no_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    no_docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d
