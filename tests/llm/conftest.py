import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, white space, near and exact copies, shared lines, long ones."""
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(12)]
    near = []
    for t in base[:6]:
        w = t.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    line = "This is a line of more than forty letters that many documents share"
    shared = [f"{words(rng, 8)}\n  {line.upper() if i % 2 else line} \n{words(rng, 5)}" for i in range(9)]
    odd = [None, "", " ", "\n", "  \n\t ", "one", "two words", "one two three four", "ünïcödé ßtraße 漢字 ​ \x1c x", "don't we'll 's 'ré  a\n\n b", "<|endoftext|> and text", "0123456789", "͸ unknown"]
    long = [words(rng, 20_000), "word " * 30_000]
    out = base + near + base[:5] + base[:1] * 20 + shared + odd + long
    rng.shuffle(out)
    return out


@pytest.fixture()
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "a"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture()
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With extra columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = ("id", "h", "n", "class", "digest", "lines", "_text", "_source", "mix_slot", "n_tokens", "key", "root")
    return df.select("*", *(F.lit("x").alias(c) for c in names))
