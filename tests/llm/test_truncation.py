import random

from plenarium.llm.truncation import truncated

SCHEMA = "part string, id long, source string, text string, cut string"
WHO = ["Members in FIN", "Several speakers", "The quoted passages"]
DO = ["treat Russia primarily as a security concern", "describe Mali as a transit country", "criticise the handling of relocation by Norway"]
END = ["", " while the reverse direction is almost absent", " although concrete measures remain unspecified", ", which suggests an asymmetric relationship"]
SHORT = ["diverging border procedures", "competition for European funding"]


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(f"{rng.choice(WHO)} {rng.choice(DO)}{rng.choice(END)}." for _ in range(rng.randint(1, 3)))
        rows.append((i, text if rng.random() < 0.8 else text[:-1]))
    return rows + [(n + i, rng.choice(SHORT)) for i in range(40)]


def flagged(spark, extra, base=True):
    rows = ([("a", i, f"f{i % 3}", t, "x") for i, t in corpus()] if base else []) + [("b", i, "f0", t, "x") for i, t in extra]
    return {(r["part"], r["id"]) for r in truncated(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_cut_and_whole(spark):
    cut = [
        "Members in FIN treat Russia primarily as a sec",
        "Members in FIN treat Russia primarily as",
        "Several speakers describe Mali as a transit country while the reverse",
        "Several speakers describe Mali as a transit country. The quoted pass",
        "Several speakers describe Mali as a transit country…",
        "Several speakers describe Mali [...]",
        "Several speakers describe Mali as a transit country, which",
        "diverging bord",
        "Several speakers describe Mali as a transit country,",
    ]
    whole = ["Members in FIN treat Russia primarily as a security concern", "Several speakers describe Mali as a transit country.", "diverging border procedures", 'They said "no more."', "", "   ", None]
    got = flagged(spark, [*enumerate(cut), *((100 + i, t) for i, t in enumerate(whole))])
    assert got == {("b", i) for i in range(len(cut))}


def test_limit_of_a_source(spark):
    """A text that ends with a clause, exactly as long as the source's cut texts, was cut there."""
    long = "Members in FIN treat Russia primarily as a security concern while the reverse direction is almost absent. " * 3
    cut = [long[k : k + 90] for k in (3, 9, 14, 22, 30, 37, 41, 52)]
    at_limit = "Several speakers treat Russia primarily as a security concern"
    at_limit = ("The quoted passages describe Mali as a transit country. " + at_limit)[-90:]
    got = flagged(spark, [*enumerate(cut), (50, at_limit), (51, at_limit[1:])])
    assert ("b", 50) in got and ("b", 51) not in got


def test_empty_repeats_and_long(spark):
    assert truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "Several speakers describe Mali…"
    rows = [("b", 1, None, text, "x"), ("b", 2, None, text, "x"), (None, None, None, text, "x"), ("b", 3, "f", "word " * 50_000 + "end.", "x")]
    assert truncated(spark.createDataFrame(rows, SCHEMA)).count() == 3
