import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def edge_texts():
    """Texts that operators must not stumble over."""
    rnd = random.Random(5)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(30_000))
    return [None, "", " ", "\n\n", "one", "one two three four", "One two\tTHREE four  five", "a\x0bb\x0cc\r\nd e f g", "é. É. ŒUVRE Straße ΟΔΟΣ",
            "日本語 テスト。 mixed 12.5% of 3,000.", "it's </s> [INST] don't <|endoftext|> ▁x", "x" * 50_000, long, long, "mail a.b@c.de, again a.b@c.de now",
            "host 10.0.0.1 card 4111 1111 1111 1111 phone +1 (632) 555-4827.", "tab\tend ", " lead", "é combining", "nbsp  two  blanks\n"]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """A table folder of edge rows: nulls in all columns, repeated rows and ids, extra columns."""
    d = str(tmp_path_factory.mktemp("edge"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r[0], r[1]) for r in docs] + [(1000 + i, t) for i, t in enumerate(edge_texts())]
    rows += [(7, "same id, another text, of some words more than five"), (1005, edge_texts()[5]), (None, "no id but words enough for a shingle"), (None, None)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, score double, base string, row int"
    spark.createDataFrame([(*r, None, "src0", None if r[1] is None else len(r[1]), 1.5, "b", 3) for r in rows], extra).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], i % 4 != 0 and 1 or 0, i % 7 == 0 and 1 or 0) for i, r in enumerate(rows) if i % 2]
    spark.createDataFrame([*labels, (None, 1, 0), (5, None, None), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
