import random

import pytest

random.seed(8)
WORDS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon"]
#: Names that the operators use inside; extra columns may have them too.
CLASHING = ["n", "bucket", "key", "rep", "component", "spans", "line", "kept", "host", "found", "node", "class", "sequence_id", "text_hash", "gone", "again", "place", "__gone", "__again", "__n", "__bad", "__host", "bad", "rep_", "size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def passage(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


def odd_rows():
    shared = passage(60, 1)
    base = passage(300, 2)
    near = base.replace(base.split()[100], "changed", 1)
    texts = [
        None, "", " \n\t ", "one", "a b c", shared + " " + passage(20, 3), passage(5, 4) + " " + shared, base, base, near, base.upper(),
        "é" * 150, "ab" * 90, "日本語 テキスト " * 12, passage(30_000, 5), "x" * 40_000, "same line\n" * 30, "\n".join(f"line {i % 7}" for i in range(90)),
        "mail me at a.b@c.example or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111", "<p>" + "#" * 30, "🙂 🙃 " * 60, shared, shared + "\n" + shared, "\x00odd\x1ccontrols\x85" * 9, passage(80, 6) + "…" + passage(80, 7),
    ]
    rows = [(i, t, None if i % 5 == 0 else ("en", "fr")[i % 2], None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[1], (None, base, None, None, None), (None, None, None, None, None), (500, base, "en", "s1", 1), (500, near, "en", "s1", 1), (510, passage(70, 31), "en", "s2", 1), (520, passage(70, 31), "en", "s2", 1), (520, passage(70, 32), "en", "s2", 1), (530, passage(70, 32) + " end", "en", "s2", 1)]
    return [(*r, *("clash" if k % 2 else None for k in range(len(CLASHING)))) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
