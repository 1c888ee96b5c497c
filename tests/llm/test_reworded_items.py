"""Benchmark items whose words were partly replaced, against the common subsequence with every document."""

import random

from voxloom.llm.decontamination import COPIED, REWORDED, leaks


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_reworded_items_are_found_and_others_are_not(spark):
    r = random.Random(41)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rn", "st", "nd", "ps", "rk", "t", "ng")]
    words = lambda n: [r.choice(vocabulary) + r.choice(["", "a", "ing"]) for _ in range(n)]
    items = {i: words(r.choice([25, 40, 90])) for i in range(12)}
    docs = {d: words(r.randrange(60, 400)) for d in range(240)}
    for d, item in zip(range(0, 240, 4), list(items.values()) * 5, strict=True):
        share = r.choice([0.0, 0.1, 0.2, 0.3])
        said = [r.choice(vocabulary) if r.random() < share else w for w in item]
        at = r.randrange(len(docs[d]))
        docs[d][at:at] = said
    shares = {(d, i): subsequence(item, text) / len(item) for d, text in docs.items() for i, item in items.items()}
    planted = {(d, k % 12) for k, d in enumerate(range(0, 240, 4))}
    want = {pair for pair in planted if shares[pair] >= COPIED}
    got = {
        (x.doc_id, x.item_id)
        for x in leaks(
            spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string"),
            spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string"),
        ).collect()
    }
    assert len(want) > 40 and len(want & got) >= 0.9 * len(want)
    assert all(shares[pair] >= REWORDED for pair in got)
    assert not got - planted or len(got - planted) <= 0.02 * len(got)
