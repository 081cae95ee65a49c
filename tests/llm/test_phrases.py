"""Collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import phrases


def plain(docs, first=2000, least=100):
    count, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for k in range(len(w) - m + 1):
                    count[lang][tuple(w[k : k + m])] += 1
    out = []
    for lang, c in count.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    longest[p[k : k + m]] = max(longest[p[k : k + m]], a)
        rows = []
        for p, a in cand.items():
            if 100 * longest[p] >= 100 * a:
                continue
            s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((s, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:first])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    rng = random.Random(3)
    common = ["Alpha", "beta", "é", "中", "ab\x00c", "delta", "x", "of", "THE", "in"]
    docs = []
    for i in range(260):
        words = [rng.choice(common) if rng.random() < 0.9 else f"rare{rng.randrange(500)}" for _ in range(60)]
        for k in range(0, 50, 13):
            words[k : k + 4] = ["once", "upon", "a", "time"][: rng.choice([2, 3, 4, 4])]
        text = "".join(w + rng.choice([" "] * 12 + ["\t", " . ", ",", "! ", "\n", "  "]) for w in words)
        docs.append((text, ["en", "de", None, "a b"][i % 4]))
    docs += [("again and again and again " * 60, "en"), ("one", "fr"), ("", "en"), (None, "en"), (None, None), (" . ", None), docs[0], docs[0]]
    docs.append(("a a a a a a a " * 3000, "fr"))
    return docs


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(t, l, "k", 1, "x") for t, l in corpus()]
    return spark.createDataFrame(rows, "text string, lang string, key string, id long, name string").repartition(5)


def test_collocations(frame, monkeypatch):
    want = plain(corpus())
    assert len({r[0] for r in want}) == 5 and any(len(r[2].split(" ")) >= 4 for r in want)
    assert got(phrases.collocations(frame)) == want


def test_words_joined_to_their_numbers(frame, monkeypatch):
    monkeypatch.setattr(phrases, "DICTIONARY_BYTES", 0)
    monkeypatch.setattr(phrases, "BATCH_BYTES", 5000)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    assert got(phrases.collocations(frame)) == plain(corpus())


def test_the_query(spark, tables, no_tables, plain_docs):
    assert phrases.op12_phrase_mining(spark, no_tables).count() == 0
    assert phrases.op12_phrase_mining(spark, tables).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_large_counts_are_exact(spark):
    row = spark.sql("select (cast(1000 as decimal(4,0)) * cast(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(34,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) s from values (10000000000000L, 20000000000001L, 30000000000000L, 70000000000L) t(a, n, l, r)").first()
    assert row.s == 1000 * 10**13 * 20000000000001 // (3 * 10**13 * 7 * 10**10)


def test_radix_sort_and_runs():
    rng = np.random.default_rng(1)
    keys = rng.choice(np.array([0, 1, 70000, 2**31, 2**32 - 1], np.uint32), size=(5000, 3))
    out = keys[phrases.radix_order(keys)]
    assert out.tolist() == sorted(keys.tolist())
    at, n = phrases.run_lengths(out)
    assert {tuple(k): c for k, c in zip(out[at].tolist(), n.tolist())} == Counter(map(tuple, keys.tolist()))
