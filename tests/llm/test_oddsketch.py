"""Near duplicates by odd sketches against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, prose

from lodestar.llm import oddsketch


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(docs):
    """(n_shingles, component_id) of each row."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)].append(d)
    return [(len(s), min(ids[find(i)], default=None)) for i, s in enumerate(sets)]


def rows_of(out):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)


def expected(docs):
    return sorted(((d, n, c, d == c) for (d, _), (n, c) in zip(docs, brute(docs))), key=str)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows_of(oddsketch.near_duplicates(df)) == expected(docs)


def test_every_kind_of_row(spark, tables, no_tables, plain_docs):
    assert rows_of(oddsketch.op13_odd_sketches(spark, tables)) == expected(plain_docs)
    assert oddsketch.op13_odd_sketches(spark, no_tables).count() == 0


def test_case_and_short_texts(spark):
    rng = random.Random(11)
    check(spark, near_groups(rng) + [(5, "One Two"), (3, "one  TWO"), (4, "one two two"), (9, "É x y z"), (8, "é x y z"), (1, ""), (2, ""), (7, None), (6, None), (10, "a b c"), (11, "A\tB\nC"), (12, "a b c a b c")])


def copies(rng, base, n, most):
    out = []
    for _ in range(n):
        words = base.split(" ")
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append(" ".join(words))
    return out


def near_groups(rng):
    texts = [t for size, most in ((300, 4), (40, 9), (60, 2), (3, 1), (25, 14)) for t in copies(rng, prose(rng, 90), size, most)]
    texts += [prose(rng, 90) for _ in range(50)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("changes", [14, 6])
def test_a_template_with_unlike_fillings(spark, monkeypatch, changes):
    monkeypatch.setattr(oddsketch, "DENSE", 60)
    monkeypatch.setattr(oddsketch, "BLOCK", 32)
    monkeypatch.setattr(oddsketch, "SETS", 16)
    rng = random.Random(changes)
    base, texts = prose(rng, 120), []
    for _ in range(250):
        words = base.split(" ")
        for k in range(changes):
            words[k * 8 + 3] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [t + " end" for t in texts[:100]]
    check(spark, list(enumerate(texts)))


def test_sketches_tell_high_similarities(spark):
    rng = np.random.default_rng(4)
    size, close, far = 2000, [], []
    for similarity, found in ((0.85, close), (0.65, far)):
        apart = round(size * (1 - similarity) / (1 + similarity))
        sets = []
        for _ in range(150):
            x = rng.integers(0, 1 << 63, size + apart, dtype=np.int64)
            sets += [np.sort(x[:size]), np.sort(x[apart:])]
        keys, sketch = oddsketch.signatures(sets)
        odd = np.bitwise_count((sketch[::2] ^ sketch[1::2]).view(np.uint64)).sum(1)
        found.append((odd, (keys[::2] == keys[1::2]).any(1).mean()))
    assert (close[0][0] <= oddsketch.most_odd()).all() and close[0][1] == 1
    assert (far[0][0] > oddsketch.most_odd()).mean() > 0.9
