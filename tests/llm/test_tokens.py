"""Token operators against their libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import packing, pieces, tokencount
from lodestar.llm.scan import Memo, batches

P = pytest.importorskip("public_tokenizers")
ALPHABET = "abcdefghij'''rvlstmde      \n\n\t\r.,!?-0123456789éßñ中　 😀́RESTΣİ\x00▁<|>\x1c\x85"


def strings(n=3000):
    rng = random.Random(3)
    fixed = ["", " ", "\n", "'", "it's we're 'r 'l 've'll", "a  b\n\n c \t 's", "<|endoftext|>x<|endoftext|>", "<|startoftext|>", "aaaa" * 50, "<s></s><0x0A>", "▁▁", "  x "]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_transducers_count_as_the_library():
    from tokenizers import Tokenizer

    path, texts, memo = P.path("byte_bpe_50k.json"), strings(), Memo(500)
    transducer, added = tokencount.load(path)
    got = np.concatenate([tokencount.count_texts(run, transducer, added, memo) for run in batches(texts, 2000)])
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


def test_agenda_encodes_as_the_library():
    p, texts, memo = pieces.load(P.path("piece_bpe_32k.model")), strings(), Memo(500)
    got = [x for run in batches(texts, 2000) for x in pieces.encode_texts(run, p, memo)]
    for t, (n, joins, shown) in zip(texts, got):
        ids = p.library.encode(t)
        assert (n, joins) == (len(ids), " ".join(map(str, ids))) and shown == p.library.decode(ids)


def test_word_ids_are_the_library_s():
    path, texts, memo = P.path("word_bpe_49k.json"), strings(), Memo(500)
    words = packing.load(path)
    got = [x.tolist() for run in batches(texts, 2000) for x in packing.token_ids(run, words, memo)]
    assert got == [e.ids for e in words.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([1, 3, 7, rng.randint(1, 60), rng.randint(50, 100), 100]) for _ in range(rng.choice([0, 1, 5, 400])))
    plan = packing.Plan(dict(counts), 100)
    held, used = defaultdict(list), Counter()
    for length, first, n, sequence, copies, offset in plan.runs:
        assert first == used[length]
        used[length] += n
        for k in range(n):
            held[sequence + k // copies].append((offset + k % copies * length, length))
    assert used == counts and set(held) == set(range(plan.sequences))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(k * n for k, n in counts.items())
    assert plan.sequences <= -(-total // 100) * 11 / 9 + 1


def test_token_queries(spark, tables, no_tables, plain_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = tokencount.op3_transducer_counts(spark, tables).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in plain_docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == want
    assert any(r.over_limit for r in out) and tokencount.op3_transducer_counts(spark, no_tables).count() == 0

    sp = pieces.load(P.path("piece_bpe_32k.model")).library
    out = pieces.op8_agenda_pieces(spark, tables).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(sha(" ".join(map(str, [*sp.encode(t or ""), 2]))) + sha(sp.decode(sp.encode(t or ""))) for _, t in plain_docs)
    assert sorted(r.ids_sha256 + r.decoded_sha256 for r in out) == want
    assert pieces.op8_agenda_pieces(spark, no_tables).count() == 0


def test_packing_query(spark, tables, no_tables, plain_docs):
    words = packing.load(P.path("word_bpe_49k.json"))
    want = []
    for i, t in plain_docs:
        ids = np.array([*words.library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i is None, i or 0, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    rows = packing.op4_dominance_packing(spark, tables).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) == -(-sum(w[4] for w in want) // 2048)
    assert packing.op4_dominance_packing(spark, no_tables).count() == 0


def _fewest(lengths, capacity):
    """Least number of sequences, by trying every set of the pieces."""
    n = len(lengths)
    total = [sum(lengths[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]
    best = [0] + [n] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        low, s = m & -m, m
        while s:
            if s & low and total[s] <= capacity:
                best[m] = min(best[m], best[m ^ s] + 1)
            s = (s - 1) & m
    return best[-1]


def test_dominance_keeps_the_optimum():
    class Reduced(packing.Plan):
        def best_fit(self):
            pass

    rng, fixed = random.Random(5), 0
    for _ in range(120):
        lengths = [rng.randint(*rng.choice([(1, 30), (8, 20), (14, 30)])) for _ in range(rng.randint(0, 8))]
        plan = Reduced(dict(Counter(lengths)), 30)
        rest = [x for x, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + _fewest(rest, 30) == _fewest(lengths, 30)
        fixed += len(lengths) - len(rest)
    assert fixed > 100
