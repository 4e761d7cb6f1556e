import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from minekit.llm import scoring
from tests.llm.test_models import EDGE, close, fold, words


def model(rows, order, mass):
    """Plain recursion over histories: (probability, counts of n-grams by length, N, V)."""
    count = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if i is None or fold(i, 7) != 2:
            tokens = words(t)
            count[1].update((w,) for w in tokens)
            padded = ["</s>", *tokens]
            for n in range(2, order + 1):
                count[n].update(tuple(padded[k : k + n]) for k in range(len(padded) - n + 1))
    total, distinct = sum(count[1].values()), len(count[1])

    def probability(word, history):
        if not history:
            return (count[1][(word,)] + 1) / (total + distinct + 1)
        lower = probability(word, history[1:])
        seen = count[len(history)][tuple(history)]
        return (count[len(history) + 1][(*history, word)] + mass * lower) / (seen + mass)

    return probability, count, total


def plain(rows, order, mass):
    probability, count, total = model(rows, order, mass)
    out = []
    for i, t in rows:
        tokens = words(t)
        padded = ["</s>", *tokens]
        score = sum(math.log10(probability(w, tuple(padded[max(0, k + 2 - order) : k + 1]) if order > 1 else ())) for k, w in enumerate(tokens))
        base = sum(math.log10(probability(w, ())) for w in tokens)
        out.append((i, i is not None and fold(i, 7) == 2, len(tokens), sum(count[1][(w,)] > 0 for w in tokens), total, base, score))
    return out


def some_rows():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(25)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    return rows + [(i + 100, rows[i][1]) for i in range(10)] + EDGE


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("sizes", [{}, {"block_chars": 700, "part_keys": 100}])
def test_orders_equal_the_recursive_model(frame, order, sizes):
    rows = some_rows()
    close(scoring.language_model_scores(frame(rows), mass=3.0, order=order, **sizes).collect(), plain(rows, order, 3.0))


def test_order_three_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = scoring.language_model_scores(documents, order=3, block_chars=60_000, part_keys=9_000).collect()
    close(got, plain(rows, 3, scoring.MASS))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_of_a_state_add_up_to_one(order):
    """Every word of the vocabulary, and an unknown one, read in the states that a text carries."""
    train = [words(t) for _, t in some_rows()]
    vocabulary = sorted({w for t in train for w in t})
    lead = ["w1", "w2", *train[0][:3], "never", "w3"]
    for n in range(len(lead) + 1):
        total = 0.0
        for word in [*[w for w in vocabulary if w != "</s>"], "never seen".replace(" ", "-"), None]:
            texts = [" ".join(t[:-1]) for t in train] + [" ".join([*lead[:n], *([word] if word else [])])]
            docs = pd.DataFrame({"text": texts, "train": [True] * len(train) + [False]})
            block = scoring.Block(docs, order)
            words_seen = sum(len(t) for t in train), len(vocabulary)
            scores = scoring.Automaton(block, block.own, sum(words_seen) + 1, 3.0).scores()
            total += 10 ** scores[block.starts[-1] + n]
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_failure_arcs_are_followed_down_the_chain():
    docs = pd.DataFrame({"text": ["a b c", "a b c", "a b x", "d"], "train": [True, True, False, True]})
    block = scoring.Block(docs, 3)
    scores = scoring.Automaton(block, block.own, 100, 2.0).scores()
    # "a b x": the state (a, b) fails to (b), that one to the root, where x is unknown
    at = block.starts[2] + 2
    assert math.isclose(10 ** scores[at], (2 / (2 + 2)) * (2 / (2 + 2)) * (1 / 100))
    # its end mark is read in the root, as x is no state
    assert math.isclose(10 ** scores[at + 1], (block.own[block.grams[0][at + 1]] + 1) / 100)


def test_order_must_be_positive(frame):
    with pytest.raises(ValueError):
        scoring.language_model_scores(frame([]), order=0)
    assert np.all(scoring.Block(pd.DataFrame({"text": [""], "train": [True]}), 3).lengths == 1)
