import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import packing as P


def unfold(sizes, capacity):
    counts = Counter(sizes)
    ranges, used = P.plan_rounds(np.array(list(counts)), np.array(list(counts.values())), capacity)
    fill, ranks = defaultdict(int), defaultdict(list)
    for size, rank, n, first in ranges:
        for i in range(n):
            fill[first + i] += size
            ranks[size].append(rank + i)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    assert set(fill) == set(range(used)) and all(v <= capacity for v in fill.values())
    return used


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200), st.integers(50, 80))
def test_every_item_is_placed_once_and_fits(sizes, capacity):
    used = unfold(sizes, capacity)
    least = -(-sum(sizes) // capacity)
    assert least <= used <= 2 * least + 1


def test_close_to_best_fit_decreasing():
    rng = random.Random(1)
    sizes = [min(512, int(rng.lognormvariate(4.5, 1)) + 1) for _ in range(5000)]
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= s]
        if fit:
            i = min(fit, key=lambda i: gaps[i])
            gaps[i] -= s
        else:
            gaps.append(512 - s)
    assert unfold(sizes, 512) <= len(gaps) * 1.01 + 1


def test_tables(spark):
    word = "alpha "
    texts = [(i, word * (i % 40)) for i in range(200)] + [(900, None), (901, ""), (902, word * 1000), (902, word * 1000), (903, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in texts], "doc_id bigint, text string, size int, part int")
    targets = spark.createDataFrame([(1, 64), (2, 300), (3, None), (None, 5), (4, 0)], "target_id bigint, capacity_tokens bigint")
    rows = P.pack(docs, targets).collect()
    counts = Counter()
    for r in P.token_counts(docs).collect():
        counts[r.doc_id] += r.n_tokens
    for t, cap in ((1, 64), (2, 300)):
        mine = [r for r in rows if r.target_id == t]
        fill, total = Counter(), Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
            total[r.doc_id] += r.n_tokens
        assert max(fill.values()) <= cap and set(fill) == set(range(max(fill) + 1))
        assert total == counts
        split = {r.doc_id for r in mine if r.piece_no > 0}
        assert split == {i for i in (902, 903) if counts[i] > cap} and all(r.n_tokens for r in mine if r.doc_id not in (900, 901) and r.doc_id % 40)
        assert len([r for r in mine if r.doc_id in (900, 901)]) == 2
    assert P.pack(docs.limit(0), targets).count() == 0 and P.pack(docs, targets.limit(0)).count() == 0


def test_tokens_are_those_of_the_public_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("don't we'll x's  a\n\n b", "Grüße, ça va? 12345", "<|endoftext|> def f(x):\n    return x", "日本語 テキスト"):
        assert len(P.encoder(P.TOKENIZER).encode_ordinary(text)) == len(t.encode(text, add_special_tokens=False).ids)
