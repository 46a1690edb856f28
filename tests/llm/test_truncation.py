import random
import time

import pytest

from sondage.llm import truncation as T

NOUNS, VERBS = "parser cache graph index folder reader writer budget".split(), "loads reads drops sorts merges".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} before the {rng.choice(NOUNS)} {rng.choice(VERBS)} it."


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = " ".join(sentence(rng) for _ in range(rng.randint(2, 8)))
        items = "\n".join(f"- fix the {rng.choice(NOUNS)}" for _ in range(12))
        end = rng.choice(["", "\n\n" + items, "\n\nStatus: open", "\n\n```\nx = 1\n```", "\n\n| a | b |\n|---|---|\n| c | d |", "\n\n" + sentence(rng) + "\n\n-- the maintainers of it all", "\n\nIt loads one, then the next, and so on..."])
        out.append((i, body + end))
    return out


def cut(spark, rows, source="s"):
    docs = spark.createDataFrame([(i, t, source, "x", 1) for i, t in rows], "doc_id bigint, text string, source string, form string, n_all int")
    return {r.doc_id for r in T.cut_documents(docs).collect()}


def test_complete_texts_are_no_case(spark):
    assert cut(spark, corpus()) == set()


def test_cuts_are_found(spark):
    rows = corpus()
    whole = " ".join(sentence(random.Random(i)) for i in range(6))
    bad = [
        whole[:-9], whole[:50], whole + " The par", whole + "\n\n- fix the", whole + "\n\n- fix the gra", whole + "\n\n```\nx = 1",
        whole + "\n\n| a | b |\n|---|---|\n| c", whole + " The parser `load_ca", whole + " The caf\ufffd", whole + " R&am", whole + " see <a hr",
        whole + " The parser reads the...", whole + " The parser re…", whole + " The parser reads [truncated]",
    ]
    assert cut(spark, rows + [(1000 + i, t) for i, t in enumerate(bad)]) == {1000 + i for i in range(len(bad))}


def test_copies_do_not_vouch_for_their_own_cut(spark):
    whole = " ".join(sentence(random.Random(i)) for i in range(6))
    ends = ["\n\nThe parser drops all of the gra", "\n\nThe gra", "\n\nReviewed-By: the gra"]  # closing, short, trailer
    copies = [(1000 + 100 * k + i, whole + end + " \n" * (i % 2)) for k, end in enumerate(ends) for i in range(40)]
    assert cut(spark, corpus() + copies) == {i for i, _ in copies}
    # different texts do: the line is a usual one then, however many rows the table has
    usual = [(2000 + i, sentence(random.Random(50 + i)) + f" Part {i}.\n\nThanks for all of the work") for i in range(4)]
    assert cut(spark, corpus() + usual) == set() == cut(spark, corpus(6000) + usual)
    assert cut(spark, corpus() + usual[:1] * 40) == {2000}


def test_spikes(spark):
    rng = random.Random(2)
    lengths = [(rng.randint(100, 900),) for _ in range(300)] + [(640,)] * 25
    df = spark.createDataFrame([("s", n) for (n,) in lengths], "source string, n_chars bigint")
    assert [(r.source, r.at_limit) for r in T.length_spikes(df, "n_chars").collect()] == [("s", 640)]


def test_nulls_empty_and_report(spark):
    assert cut(spark, []) == set()
    assert cut(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "\u200b"), (5, "## Heading"), (5, "Done.")]) <= {5}
    docs = spark.createDataFrame([(1, "Done.", None), (2, "It is `cut", None), (3, None, "a")], "doc_id bigint, text string, source string")
    assert [tuple(r) for r in T.source_report(docs).collect()] == [(None, 2, 1, 0.5, 0)]


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 200_000 + "a", "a\n" * 50_000, ". " * 80_000, "`" * 50_001, "| " * 50_000, "&" * 60_000, "<" * 60_000, "-" * 90_000, "a " * 90_000 + "...", "(" * 50_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    T.read_end(text)
    assert time.process_time() - began < 5
