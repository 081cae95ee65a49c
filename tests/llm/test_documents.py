"""Document operators against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, prose
from pyspark.sql import functions as F

from lodestar.llm import chat, components, fingerprint, join, langid, lines, quality, sharding


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = word_list(t)
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


# --- 1 ---


def weighted_jaccard(a, b):
    a, b = Counter(shingles(a)), Counter(shingles(b))
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def test_fingerprints(spark, tables, no_tables, plain_docs):
    out = fingerprint.op1_weighted_sampling(spark, tables).collect()
    assert len(out) == len(plain_docs)
    order = sorted((d for d in plain_docs if d[0] is not None), key=lambda d: -d[0])
    of = {r.doc_id: r for r in out}
    by_text = defaultdict(set)
    for i, t in plain_docs:
        if i is not None:
            by_text[t or ""].add(of[i].fingerprint)
    assert all(len(s) == 1 for s in by_text.values())
    for (i, t), (j, n) in zip(order, order[1:]):
        if i == j or (j, n) == order[-1]:
            continue
        t, n = t or "", n or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        assert of[i].n_chars == len(t)
        if sum(d[0] == i for d in order) == 1:
            assert of[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            assert of[i].near_edited == pytest.approx(weighted_jaccard(t, changed), abs=0.3)
            assert of[i].near_next == pytest.approx(weighted_jaccard(t, n), abs=0.3)
    assert fingerprint.op1_weighted_sampling(spark, no_tables).count() == 0


def test_collision_rate_is_the_generalised_jaccard(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        words = [prose(rng, 1) for _ in range(60)]
        a, b = " ".join(words * rng.randint(1, 3)), " ".join([*words[:40], *(prose(rng, 1) for _ in range(20))])
        rows += [(k, 0, a), (k, 1, b)]
        want[k] = weighted_jaccard(a, b)
    df = fingerprint.fingerprints(spark.createDataFrame(rows, "k int, v int, text string"), ["k", "v"])
    pair = df.groupBy("k").pivot("v", [0, 1]).agg(F.first("samples"))
    got = {r.k: r.s for r in pair.select("k", fingerprint.likeness(F.col("0"), F.col("1")).alias("s")).collect()}
    assert sum(got[k] - want[k] for k in want) / len(want) == pytest.approx(0, abs=0.025)


# --- 2 ---


def char_shingles(line):
    u = line.encode("utf-16-be")
    return {u[2 * k : 2 * k + 18] for k in range(max(1, len(u) // 2 - 8))}


def test_fuzzy_lines(spark, no_docs):
    rng = random.Random(2)
    base = [prose(rng, 30) for _ in range(20)]
    texts = {i: "\n".join([base[i], "", base[(i + 1) % 20], base[i].replace(" ", "  ", 1) if i % 4 == 0 else prose(rng, 9)]) for i in range(20)}
    texts |= {20: None, 21: "", 22: base[3] + "x", 23: "tiny\ntiny", 24: "tiny"}
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in texts.items()], "doc_id long, text string, at string, cut string")
    out = {r.doc_id: r for r in lines.drop_lines(df).collect()}
    occ = [(i, k, x) for i, t in sorted(texts.items()) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = {x: char_shingles(x) for *_, x in occ}
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            n = len(sets[x] & sets[y])
            if 5 * n >= 4 * (len(sets[x]) + len(sets[y]) - n):
                root[find(x)] = find(y)
    seen, want = set(), defaultdict(list)
    for i, k, x in occ:
        if find(x) in seen:
            want[i].append(k)
        seen.add(find(x))
    assert {i: r.dropped_lines for i, r in out.items()} == {i: want[i] for i in texts}
    assert out[20].text is None and out[21].text == "" and out[23].text == "tiny" and out[24].text == ""
    assert lines.drop_lines(no_docs).count() == 0


def test_all_pairs_of_a_bucket(spark):
    rng = random.Random(22)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    form, own = make(72), [make(36) for _ in range(600)]  # lines on one template, with near copies of some
    copies = {form + w: form + w[:-9] + make(9) for w in own[::3]}
    df = spark.createDataFrame(list(enumerate([*(form + w for w in own), *copies.values()])), "doc_id long, text string")
    assert len(char_shingles(form + own[0]) & char_shingles(form + own[1])) / len(char_shingles(form + own[0]) | char_shingles(form + own[1])) < 0.6
    ids = {r.text: r.id for r in df.select("text", lines.line_id(F.col("text")).alias("id")).collect()}
    signed = {r.id: r for r in lines.signatures(df, "text", "doc_id").collect()}
    band = lambda t, k: tuple(signed[ids[t]][f"d{k * lines.ROWS + r}"] for r in range(lines.ROWS))
    root = {r.id: r.root for r in lines.classes(df).collect()}
    shared = [(t, c) for t, c in copies.items() if any(band(t, k) == band(c, k) for k in range(lines.BANDS))]
    assert all(5 * len(char_shingles(t) & char_shingles(c)) >= 4 * len(char_shingles(t) | char_shingles(c)) for t, c in shared) and len(shared) > 190
    assert [t for t, c in shared if ids[t] not in root or root[ids[t]] != root.get(ids[c])] == []


def test_near_variants_are_not_listed(spark, monkeypatch):
    """Of lines on one template just below a link, every pair was listed and joined with its texts."""
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    form = make(120)
    texts = [form + "".join(chr(0x4E00 + 16 * k + j) for j in range(16)) for k in range(80)]  # 112 of 144 shingles are shared
    texts += [t[:-3] + make(3) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed, stash = [], lines.stash
    monkeypatch.setattr(lines, "stash", lambda rows, label: (out := stash(rows, label), label == "line-remaining" and listed.append(out.count()))[0])
    found = {(r.id, r.root) for r in lines.classes(df).collect()}
    assert sum(listed) < 500
    assert len(found) == 40 and len({root for _, root in found}) == 20


def test_lines_of_odd_rows(spark, tables, plain_docs):
    assert lines.op2_fuzzy_lines(spark, tables).count() == len(plain_docs)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100 + k, 99) for k in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 99 for k in range(99, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_set_meets_a_pivot_once(spark, monkeypatch):
    """Near copies share many nodes of one pivot: a set met it once a node."""
    rng = random.Random(9)
    base = prose(rng, 200).split()
    texts = [" ".join(base[:at] + [f"w{at}"] + base[at + 1 :]) for at in range(len(base))][:150]
    met, stash = [], join.stash
    monkeypatch.setattr(join, "stash", lambda rows, label: (out := stash(rows, label), label == "met" and met.append(out))[0])
    found = join.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert met and all(m.count() == m.select("eid", "pivot").distinct().count() for m in met)
    assert {r.class_id for r in found} == {0} and {r.n_links for r in found} == {len(texts) - 1}


# --- 5 ---


def test_crf_labels_words_and_documents(spark, no_tables, tables):
    rng = random.Random(4)
    make = lambda stem, n: " ".join(rng.choice(stem) + prose(rng, 1)[:2] + rng.choice(stem) for _ in range(n))
    rows = [(i, make(("der", "sch"), 40) if i % 2 else make(("tion", "eau"), 40), "de" if i % 2 else "fr") for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None, "de"), (901, "12 !", "fr"), (None, rows[1][1], None)], "doc_id long, text string, lang string")
    model = langid.learn(langid.sample(df))
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [r for r in df.filter(langid.held_out()).collect() if r.doc_id < 900]
    assert len(held) > 50 and all(out[r.doc_id].lang_pred == r.lang and out[r.doc_id].score > 0.9 for r in held)
    assert (out[900].lang_pred, out[901].lang_pred, out[900].score) == ("und", "und", 0.0)
    text = make(("der", "sch"), 20) + " " + make(("tion", "eau"), 20)
    _, spoken = langid.predict_texts([text], *model, langid.Memo(), by_word=True)
    assert [lab for _, lab in spoken[0]].count("de") in range(17, 24) and spoken[0][0][1] == "de" and spoken[0][-1][1] == "fr"
    assert langid.op5_crf_language(spark, no_tables).count() == 0
    assert langid.op5_crf_language(spark, tables).filter("score between 0 and 1").count() == 27


# --- 6 ---


def test_histogram_sort(spark, docs, no_docs, tables, plain_docs):
    rng = random.Random(6)
    many = spark.createDataFrame([(i, "hot text " * 20 if i % 3 == 0 else prose(rng, rng.randint(1, 60)), i) for i in range(4000)], "doc_id long, text string, piece int")
    out = sharding.histogram_sort(many, shards=8).collect()
    sizes, slots = Counter(), defaultdict(set)
    for r in out:
        sizes[r.shard] += len(r.text) + 16
        slots[r.shard].add(r.slot)
    assert len(out) == 4000 and "piece" in out[0].asDict()
    assert max(sizes.values()) - min(sizes.values()) < 1500 and all(s == set(range(len(s))) for s in slots.values())
    small = sharding.op6_histogram_sort(spark, tables).collect()
    assert sorted(r["size"] for r in small) == sorted(len((t or "").encode()) + 16 for _, t in plain_docs)
    for s in {r.shard for r in small}:
        assert sorted(r.slot for r in small if r.shard == s) == list(range(sum(r.shard == s for r in small)))
    assert sharding.histogram_sort(docs).count() == len(plain_docs) and sharding.histogram_sort(no_docs).count() == 0


# --- 7 ---


def stats(t):
    w = word_list(t)
    c, covered = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
    for k in range(len(w) - 4):
        if c[tuple(w[k : k + 5])] > 1:
            covered |= set(range(k, k + 5))
    own = [x for x in (t or "").split("\n") if word_list(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(own) - len(set(own)), len(covered)


def test_statistics(spark):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a b c d e a b c d e x", "a a a a a a a", "x\x0by\x0cz w", "l\nl\n \nl", "#*$%&|<>", *(" ".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(60))]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.with_statistics(df).collect():
        n, *rest = want = stats(texts[r.doc_id])
        assert tuple(r[s] for s in quality.STATISTICS) == want, texts[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)


def test_decision_list_learns_thresholds(spark, tables, no_tables):
    rng = random.Random(8)
    rows = [(i, prose(rng, 20) + (" $ # $ #" * 5 if i % 4 == 0 else " " + prose(rng, 20)), i % 4 == 0) for i in range(600)]
    df = quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string, bad boolean"))
    rules = quality.learn(df)
    kept = {r.doc_id for r in df.filter(quality.verdict(rules)).select("doc_id").collect()}
    assert kept == {i for i, _, bad in rows if not bad} and len(rules) == 1
    assert quality.op7_decision_list(spark, tables).count() == 27
    assert quality.op7_decision_list(spark, no_tables).count() == 0


# --- 9 ---


def test_windows_read_back(spark, tables, no_tables):
    out = {r.conv_id: r for r in chat.op9_budgeted_windows(spark, tables).collect()}
    conv = spark.read.parquet(f"{tables}/conversations.parquet").orderBy("turn").collect()
    said = "</s>[INST] ok [/INST]"
    every = [(r.conv_id, r.role or "", r.text or "") for r in conv] + [(-7, "user", said), (-7, "assistant", said)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {e[0] for e in every}:
        own = [(r, t) for i, r, t in every if i == c]
        lost = "".join(t for r, t in own if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(lost), sha(lost))
    assert set(out) == {e[0] for e in every}
    rows = spark.read.parquet(f"{tables}/conversations.parquet").filter("conv_id = 1")
    shown = chat.windows(rows).orderBy("window").collect()
    assert len(shown) > 2 and all(r.formatted.startswith("<|system|>be brief<|end|>") for r in shown)
    assert all(r.n_repeated >= 1 for r in shown[1:]) and shown[0].n_repeated == 0
    assert {r.conv_id for r in chat.op9_budgeted_windows(spark, no_tables).collect()} == {-7}


# --- 10 ---


def brute_links(rows):
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(t, []).append(i)
    sets = {t: set(shingles(t)) for t in texts}
    linked = defaultdict(set)
    for a in texts:
        for b in texts:
            n = len(sets[a] & sets[b])
            if a != b and sets[a] and sets[b] and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                linked[a].add(b)
    return texts, linked


def test_links_of_odd_rows(spark, docs, no_docs, plain_docs):
    texts, linked = brute_links(plain_docs)
    out = join.links(docs).collect()
    assert len(out) == len(plain_docs)
    n_of = Counter((r.doc_id, r.n_links) for r in out if r.text_id is not None)
    assert n_of == Counter((i, len(linked[t])) for i, t in plain_docs if t is not None)
    of = {r.doc_id: r for r in out if r.doc_id is not None}
    assert of[14].class_id == 0 and of[12].class_id == of[13].class_id == 1 and of[15].class_id == 15 and of[19].class_id == 18
    assert join.links(no_docs).count() == 0


def test_hot_group_and_common_passage(spark):
    rng = random.Random(10)
    base, passage = prose(rng, 100).split(" "), prose(rng, 70)
    rows = []
    for i in range(260):  # a group of near copies, larger than a node and a block
        w = list(base)
        w[rng.randrange(100)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, 60) + " " + passage + " " + prose(rng, 60)) for i in range(150)]
    texts, linked = brute_links(rows)
    out = {r.doc_id: r for r in join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_links == len(linked[t]) for i, t in rows)
    assert {out[i].class_id for i in range(260)} == {0} and all(out[1000 + i].class_id == 1000 + i for i in range(150))


def test_shortened_copies_in_a_large_node(spark):
    rng = random.Random(30)
    base = prose(rng, 1200).split(" ")
    texts = [base[: rng.randint(1186, 1200)] + [f"edit{i}"] for i in range(200)]
    texts += [base[:n] for n in rng.sample(range(1104, 1150), 12)] + [base[:n] for n in rng.sample(range(936, 944), 6)]  # not links of the first, but of some that are
    rows = list(enumerate(map(" ".join, texts)))
    _, linked = brute_links(rows)
    out = {r.doc_id: r for r in join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_links for i, r in out.items()} == {i: len(linked[t]) for i, t in rows}
    assert {r.class_id for r in out.values()} == {0}


def test_keep_one(spark, docs):
    kept = [r.doc_id for r in join.keep_one(docs).select("doc_id").collect()]
    assert not {12, 13, 14, 19} & set(kept) and {0, 1, 2, 15, 18} <= set(kept) and kept.count(3) == 1


def test_fixture_has_clashing_columns(docs):
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_windows_hold_budget_history_and_masks(spark):
    turns = [(1, 0, "system", "rules", 3)] + [(1, k, "user" if k % 2 else "assistant", f"turn {k}", 5 + k % 4) for k in range(1, 30)] + [(1, 30, "user", "long", 90)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, c long")
    shown = [r.asDict() for r in chat.windows(rows, budget=64, history=20, tokens="c").orderBy("window").collect()]
    cost = {t[3]: t[4] + chat.TURN_COST for t in turns}
    seen, learned = [], []
    for k, w in enumerate(shown):
        said = [p.split("|>", 1)[1] for p in w["formatted"].split("<|end|>")[:-1]]
        old, new = said[: w["n_repeated"]], said[w["n_repeated"] :]
        assert sum(cost[t] for t in said) <= 64 or new == ["long"]
        assert new and said[0] == "rules" and (old[1:] == seen[len(seen) - len(old) + 1 :] if k else not old)
        assert sum(cost[t] for t in old[1:]) <= 20
        if k and len(seen) > len(old[1:]) + 1:  # one more turn of history would not fit
            assert sum(cost[t] for t in [seen[len(seen) - len(old)], *old[1:]]) > 20
        seen += new
        learned += [w["formatted"][m["start"] : m["start"] + m["length"]] for m in w["loss"]]
    assert seen == [t[3] for t in turns] and learned == [t[3] for t in turns if t[2] == "assistant"]


def test_forward_backward_is_the_sum_over_paths():
    rng = np.random.default_rng(3)
    score, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True] * 4, [True] * 3 + [False]])
    p, pairs = langid.marginals(score, mask, moves)
    want, steps = np.zeros_like(p), np.zeros_like(pairs)
    for c in range(2):
        n = int(mask[c].sum())
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.array([np.exp(sum(score[c, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        for path, w in zip(paths, weight / weight.sum()):
            for i, y in enumerate(path):
                want[c, i, y] += w
            for a, b in zip(path, path[1:]):
                steps[a, b] += w
    assert np.allclose(p, want) and np.allclose(pairs, steps)
