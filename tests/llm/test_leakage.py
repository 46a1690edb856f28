import random
import time

import pytest

from sondage.llm.leakage import ItemIndex, furthest, leaked_items, plain_words

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(3, 9))) for _ in range(500)]


def words(n, rng):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_plain_words():
    assert plain_words("He<b>ll</b>o, W&ouml;rld&#33; snap-\nshot **bold**<br>x_y\u200bz") == ["hello", "wörld", "snapshot", "bold", "x", "yz"]
    assert plain_words(None) == plain_words("") == plain_words(" .,;") == []


def brute(item, doc, n=20, per=8):
    """Whether some n..2n-1 words of the item are in the document within the allowed word edits."""
    for i in range(len(item)):
        for size in range(n, min(2 * n, len(item) - i + 1)):
            part, most = item[i : i + size], size // per
            row = [0] * (len(doc) + 1)
            for a, w in enumerate(part):
                new = [a + 1]
                for b, x in enumerate(doc):
                    new.append(min(row[b] + (w != x), row[b + 1] + 1, new[-1] + 1))
                row = new
            if min(row) <= most:
                return True
    return False


def found(index, doc):
    return any(index.verify(doc, k, d) for (_, k), d in index.candidates([" ".join(doc)]).items())


def test_against_brute_force():
    rng = random.Random(11)
    item = words(40, rng)
    index = ItemIndex([(1, " ".join(item))])
    for trial in range(120):
        size = rng.choice([12, 18, 19, 20, 22, 24, 26, 30, 33])
        start = rng.randint(0, len(item) - size)
        part = item[start : start + size]
        for _ in range(rng.randint(0, 5)):
            k = rng.choice([0, len(part) - 1, rng.randrange(len(part))])  # often at the edges
            what = rng.choice("sdi")
            if what == "s":
                part[k] = "changed"
            elif what == "d":
                del part[k]
            else:
                part.insert(k, "x" * rng.randint(1, 100))
        doc = words(10, rng) + part + words(10, rng)
        assert found(index, doc) == brute(item, doc), (trial, part)


@pytest.mark.parametrize("letters", [1, 5, 10, 20, 34, 40, 60, 100])
def test_words_put_in_may_have_any_length(letters):
    rng = random.Random(letters)
    item = words(60, rng)
    index = ItemIndex([(1, " ".join(item))])
    for _ in range(40):
        start = rng.randint(0, 40)
        part = item[start : start + 20]
        for _ in range(2):
            part.insert(rng.randint(1, len(part) - 1), "q" * letters)
        assert found(index, words(30, rng) + part + words(30, rng))


@pytest.mark.parametrize("n,edits", [(20, 2), (24, 3), (31, 3), (32, 4), (39, 4)])
def test_the_longest_words_may_change(n, edits):
    rng = random.Random(n)
    item = [w * rng.choice([1, 1, 3]) for w in words(n, rng)]
    index = ItemIndex([(1, " ".join(item))])
    for trial in range(20):
        at = sorted(range(n), key=lambda i: -len(item[i]))[:edits] if trial == 0 else rng.sample(range(n), edits)
        doc = words(9, rng) + ["zz" if i in at else w for i, w in enumerate(item)] + words(9, rng)
        assert found(index, doc)


def test_bound_is_kept_for_short_words():
    short = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopq"][:40]
    index = ItemIndex([(1, " ".join(short)), (2, " ".join(words(40, random.Random(1))))])
    doc = ["zz"] * 5 + short[5:25] + ["zz"] * 5
    assert found(index, doc) and len(index.tables) == 2 and min(t.need.min() for t in index.tables) >= 1


def test_furthest_reach():
    a, b = "a b c d e f".split(), "a x c d f".split()
    assert furthest(a, b, 0, 0, 1, 3) == [1, 4, 6, 6]
    assert furthest(a, b, 5, 4, -1, 3) == [1, 4, 6, 6]
    assert furthest(a, [], 0, 0, 1, 1) == [0, 1] and furthest([], b, 0, 0, 1, 1) == [0, 0]


def test_markup_of_any_length_is_left_out():
    assert plain_words("a <!-- " + "long comment " * 5000 + "--> b <i class='" + "x " * 900 + "'>c</i> <!-- open") == ["a", "b", "c", "open"]


@pytest.mark.parametrize("text", ["<!--" * 50_000, "<a " * 80_000, "a " * 200_000, "x" * 400_000, "&" * 100_000, "-\n" * 100_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    index = ItemIndex([(1, " ".join(words(40, random.Random(2))))])
    assert not found(index, plain_words(text))
    assert time.process_time() - began < 10


def test_tables(spark):
    rng = random.Random(5)
    passage = words(30, rng)
    items = spark.createDataFrame([(1, "s", "Read. " + " ".join(passage)), (2, "s", " ".join(passage) + " other?"), (3, "s", None), (4, "s", "too short"), (5, "s", "")], "item_id bigint, suite string, item_text string")
    hidden = "<p>" + ", ".join(w.upper() for w in passage[:22]) + "</p>"
    docs = spark.createDataFrame(
        [(1, hidden, 0), (2, hidden, 0), (3, None, 0), (4, "", 0), (5, " ".join(words(20000, rng)) + " " + " ".join(passage), 0), (6, " ".join(passage[:15]), 0)],
        "doc_id bigint, text string, item_id int",
    )
    assert {tuple(r) for r in leaked_items(docs, items).collect()} == {(d, i) for d in (1, 2, 5) for i in (1, 2)}
    assert {tuple(r) for r in leaked_items(docs, items, block_chars=200).collect()} == {(d, i) for d in (1, 2, 5) for i in (1, 2)}
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs, items.limit(0)).count() == 0
