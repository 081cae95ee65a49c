"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters.  Emission scores sum hashed features of a word: itself (lexicon), its
affixes of one to three letters, its character bigrams and trigrams with borders.  Transition scores
between neighbouring words are learned with them, on chains of which some are spliced from two
languages, so that code-switched text changes label where it should.  Forward-backward gives each
word its label probabilities; a document's language is the label with the largest expected share of
words, and the score is that share.

Learning takes a bounded sample (``PER_LANGUAGE`` rows of a language, of at most ``MOST_CHARS``
characters each) by a hash of the id; prediction takes the whole text in chains of ``CHAIN`` words.

Texts that are null, empty or without a letter are ``und`` with score 0; so is every text if no
labelled row is there to learn from.  Rows with a null id are not learned from and not held out.
Repeated rows and other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .scan import LETTER, NEEDS_E, SINGLE, E, ELL, Memo, _mix, batches, joined, slice_hashes, class_table

PER_LANGUAGE, MOST_CHARS = 300, 200_000
CHAIN, DIMENSIONS, EPOCHS, BATCH, RATE = 64, 1 << 15, 3, 256, 0.3
#: Characters and words held at a time: what a Python worker needs beside its Arrow batch.
CHARS, HELD = 1 << 19, 200_000
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) of every feature of the words."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    own, number = [], []
    with np.errstate(over="ignore"):
        gram = codes.copy()
        for n in range(2, 5):
            gram = gram[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            inside = owner[: len(gram)] == owner[n - 1 :] if len(gram) else np.empty(0, bool)
            if n < 4:
                own.append(owner[: len(gram)][inside])
                number.append(gram[inside] + np.uint64(n))
            for k, at in ((1, starts), (2, ends - n)):  # prefixes and suffixes
                ok = sizes > n
                own.append(np.flatnonzero(ok))
                number.append(gram[at[ok]] + np.uint64(16 * k + n))
        own.append(np.arange(len(words)))
        number.append(slice_hashes(codes.astype(np.int64), starts, ends))
        return np.concatenate(own), (_mix(np.concatenate(number)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    own, number = features(words)
    return np.stack([np.bincount(own, weights[number, k], len(words)) for k in range(weights.shape[1])], 1).astype(np.float32)


def marginals(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on chains (chain, place, label): (label probabilities, expected moves)."""
    n, t, k = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    move = np.exp(moves - moves.max())
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    a = np.full((n, k), 1.0 / k, emit.dtype)
    for i in range(t):
        now = (emit[:, i] if i == 0 else emit[:, i] * (a @ move))
        now /= now.sum(1, keepdims=True)
        a = np.where(mask[:, i, None], now, a)
        ahead[:, i] = a
    b = np.full((n, k), 1.0 / k, emit.dtype)
    for i in range(t - 1, -1, -1):
        back[:, i] = b
        now = (emit[:, i] * b) @ move.T
        now /= now.sum(1, keepdims=True)
        b = np.where(mask[:, i, None], now, b)
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    pairs = np.einsum("nti,ntj->ntij", ahead[:, :-1], emit[:, 1:] * back[:, 1:]) * move
    pairs /= pairs.sum((2, 3), keepdims=True)
    return p * mask[:, :, None], (pairs * mask[:, 1:, None, None]).sum((0, 1))


def word_slices(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letter = np.isin(class_table()[codes], (LETTER, SINGLE, NEEDS_E, ELL, E))
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def learn(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels, feature weights, moves) from (label, text) rows."""
    labels = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(0)
    number: dict[str, int] = {}
    pieces: list[list[np.ndarray]] = [[] for _ in labels]
    for lang, text in rows:
        whole, codes, _ = joined([text.lower()])
        s, e = word_slices(codes)
        ids = np.array([number.setdefault(whole[a:b], len(number)) for a, b in zip(s.tolist(), e.tolist())], np.int64)
        pieces[labels.index(lang)].extend(ids[i : i + CHAIN // 2] for i in range(0, len(ids), CHAIN // 2))
    chains = []  # (words, gold labels): two pieces each, a third of them of two languages
    every = [(k, p) for k, own in enumerate(pieces) for p in own if len(p)]
    for k, p in every:
        j = k if rng.random() < 2 / 3 or len(labels) < 2 else int(rng.integers(len(labels)))
        q = pieces[j][int(rng.integers(len(pieces[j])))]
        chains.append((np.concatenate([p, q]), np.concatenate([np.full(len(p), k), np.full(len(q), j)])))
    weights, moves = np.zeros((DIMENSIONS, len(labels)), np.float64), np.zeros((len(labels), len(labels)))
    if not chains or len(labels) < 2:
        return labels, weights.astype(np.float32), moves.astype(np.float32)
    own, feature = features(list(number))
    order = np.argsort(own, kind="stable")
    own, feature = own[order], feature[order]
    first = np.searchsorted(own, np.arange(len(number) + 1))
    seen, seen_moves = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for lo in range(0, len(chains), BATCH):
            some = [chains[i] for i in order[lo : lo + BATCH]]
            words = np.zeros((len(some), CHAIN), np.int64)
            gold, mask = np.zeros((len(some), CHAIN), np.int64), np.zeros((len(some), CHAIN), bool)
            for i, (w, g) in enumerate(some):
                words[i, : len(w)], gold[i, : len(w)], mask[i, : len(w)] = w, g, True
            distinct, at = np.unique(words, return_inverse=True)
            n = first[distinct + 1] - first[distinct]
            flat = feature[np.repeat(first[distinct] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            holder = np.repeat(np.arange(len(distinct)), n)
            score = np.stack([np.bincount(holder, weights[flat, k], len(distinct)) for k in range(len(labels))], 1)[at.reshape(words.shape)]
            p, pairs = marginals(score, mask, moves)
            error = np.eye(len(labels))[gold] * mask[:, :, None] - p
            of_word = np.stack([np.bincount(at.ravel(), error[:, :, k].ravel(), len(distinct)) for k in range(len(labels))], 1)
            grad = np.stack([np.bincount(flat, of_word[holder, k], DIMENSIONS) for k in range(len(labels))], 1) / len(some)
            seen += grad * grad
            weights += RATE * grad / np.sqrt(seen)
            gold_pairs = np.zeros_like(moves)
            both = mask[:, 1:]
            np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            step = (gold_pairs - pairs) / len(some)
            seen_moves += step * step
            moves += RATE * step / np.sqrt(seen_moves)
    return labels, weights.astype(np.float32), moves.astype(np.float32)


def sample(df: DataFrame, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, str]]:
    """About ``per_language`` rows of each language, picked by a hash of the id."""
    usable = df.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    scale = 1 << 30
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit(5)), F.lit(scale))
    wanted = F.lit(False)
    for name, n in sorted(counts.items()):
        wanted |= (F.col(lang) == name) & (place < int(scale * min(1.0, per_language / n)))
    rows = usable.filter(wanted & (F.length(text) <= most_chars)).select(doc_id, lang, text).collect() if counts else []
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[1], r[0]))]


def predict_texts(texts: list[str], labels: list[str], weights: np.ndarray, moves: np.ndarray, memo: Memo, by_word: bool = False):
    """(label, score) of each text; with ``by_word`` also each text's (word, label) list."""
    whole, codes, bounds = joined([t.lower() for t in texts])
    s, e = word_slices(codes)
    out = [(UNKNOWN, 0.0)] * len(texts)
    spoken: list[list] = [[] for _ in texts]
    if len(s) and labels:
        which, values = memo.look(slice_hashes(codes, s, e), lambda p: [x.tobytes() for x in emissions([whole[a:b] for a, b in zip(s[p].tolist(), e[p].tolist())], weights)])
        cut = np.searchsorted(s, bounds)
        n = np.diff(cut)
        links = -(-n // CHAIN)
        base = np.concatenate([[0], np.cumsum(links)])
        place = np.arange(len(s)) - np.repeat(cut[:-1], n)
        row, col = np.repeat(base[:-1], n) + place // CHAIN, place % CHAIN
        score = np.zeros((base[-1], CHAIN, len(labels)), np.float32)
        mask = np.zeros((base[-1], CHAIN), bool)
        score[row, col], mask[row, col] = np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1)[which], True
        p, _ = marginals(score, mask, moves)
        of_word = p[row, col]
        sums = np.concatenate([np.zeros((1, len(labels))), np.cumsum(of_word, 0, dtype=np.float64)])
        share = sums[cut[1:]] - sums[cut[:-1]]
        best, total = share.argmax(1), share.sum(1)
        out = [(labels[best[i]], float(min(1.0, share[i, best[i]] / total[i]))) if n[i] else (UNKNOWN, 0.0) for i in range(len(texts))]
        if by_word:
            at = of_word.argmax(1)
            spoken = [[(whole[s[j] : e[j]], labels[at[j]]) for j in range(cut[i], cut[i + 1])] for i in range(len(texts))]
    return (out, spoken) if by_word else out


def identify(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    labels, weights, moves = model
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(HELD)
        for part in parts:
            found = [x for texts in batches(part[text].fillna("").tolist(), CHARS) for x in predict_texts(texts, labels, weights, moves, memo)]
            yield part[keep].assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    return df.select(*keep).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document.  Null texts, and texts without a letter, are ``und``; labels of equal share
    go to the first in order of names; repeated rows, very long texts and null ids are predicted like others; an empty
    table gives no rows; only id, text and (to learn) language are read."""
    docs = documents(spark, sf_dir)
    model = learn(sample(docs))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
