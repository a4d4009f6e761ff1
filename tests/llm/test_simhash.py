"""SimHash links against all pairs, hashes and fingerprints against the xxhash library."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from vectorlint.llm import simhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), seed=42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, budget=4):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= budget:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    groups = {}
    for f in fps:
        groups.setdefault(root(f), set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_xxh64():
    r = random.Random(1)
    b = np.frombuffer(r.randbytes(5000), np.uint8)
    size = np.array([*range(100), 1000, 3999, 4000])
    start = np.array([r.randrange(5000 - n + 1) for n in size])
    assert simhash.xxh64(b, start, size).tolist() == [xxhash.xxh64_intdigest(b[s:s + n].tobytes(), seed=42) for s, n in zip(start, size)]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4096)             # texts in several pieces
    r = random.Random(2)
    texts = [None, "", " \n\t ", "Word", "a  B\tc", "A b c d", "\x0b one two\x0cthree four five ", "é É   x y 😀 z", "same words again " * 700, "x" * 9000]
    texts += [" ".join(r.choice(["the", "Of", "a", "nearduplicate", "\n"]) + r.choice(["", "s", "ly"]) for _ in range(r.randrange(1, 600))) for _ in range(40)]
    assert simhash.fingerprints_of(texts).tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("leaves", [2, 40, 1024])
def test_links(spark, monkeypatch, leaves):
    """A dense group around one fingerprint, chains at the budget, neighbours just beyond it."""
    monkeypatch.setattr(simhash, "LEAVES", leaves)
    r = random.Random(leaves)
    fps, x = {0, 2 ** 64 - 1}, r.getrandbits(64)
    for _ in range(150):
        fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))))
    for _ in range(60):
        c = r.getrandbits(64)
        for _ in range(4):
            fps.add(c)
            c ^= sum(1 << b for b in r.sample(range(64), r.choice([3, 4, 4, 5, 5])))
    fps |= {sum(1 << b for b in bits) for bits in ([0, 1, 2, 63], [10, 11, 12, 13, 14], [0, 16, 32, 48])}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    got = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp bigint")).collect()
    pairs = [(p.a % 2 ** 64, p.b % 2 ** 64) for p in got]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for f in fps:
        groups.setdefault(root(f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == brute_groups(fps)


def brute(texts):
    """component id and fingerprint of each (id, text)."""
    fp = [brute_fingerprint(t) for _, t in texts]
    of = {f: g[0] for g in brute_groups(set(fp)) for f in g}
    least = {}
    for (i, _), f in zip(texts, fp):
        least[of[f]] = min([v for v in (least.get(of[f]), i) if v is not None], default=None)
    return sorted((str(i), f"{f:016x}", str(least[of[f]])) for (i, _), f in zip(texts, fp))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_near_duplicates(spark):
    r = random.Random(4)
    texts = []
    for g in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
            texts.append((len(texts), " ".join(w)))
    texts += [(500 + i, texts[0][1]) for i in range(200)]        # over half of the rows are copies
    assert got(simhash.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5))) == brute(texts)


def test_odd_tables(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(simhash.near_duplicates(odd_docs)) == brute(rows)
    assert simhash.near_duplicates(odd_docs.limit(0)).collect() == []
