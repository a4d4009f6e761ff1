"""Merkle proofs against a plain recursive version, and on odd tables."""

import hashlib
import random
import zlib

import pytest

from vectorlint.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=False):
    values = [row[c] for c in merkle.FIELDS]
    if text is not False:
        values[4] = text
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """(last digest, siblings and own place of each node, level by level)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([H(*d[i:i + 3]) for i in range(0, len(d), 3)])
    ways = []
    for i in range(len(digests)):
        way = []
        for d in levels[:-1]:
            run = d[i // 3 * 3:i // 3 * 3 + 3]
            way.append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    built = {s: tree([d for d, _ in groups[s]]) for s in order}
    root, tops = tree([built[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (leaf, r), way in zip(groups[s], built[s][1]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            d = leaf_of(r, r["text"].replace("\n", "")) if hit and r["text"] is not None else leaf
            for at, others in way + tops[k]:
                d = H(*others[:at], d, *others[at:])
            out.append((str(r["doc_id"]), str(s), leaf, built[s][0], root, H(*[o for _, os in way + tops[k] for o in os]), d, d == root))
    return sorted(out)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, rank string, tree string, digest string, n string"


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], *"xxxxx") for r in rows], SCHEMA).repartition(parts)


def got(df):
    return sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 6])
def test_proofs(spark, monkeypatch, levels):
    """A hot source, sources of one and of three rows, nulls, repeated ids and repeated rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    r = random.Random(levels)
    rows = [dict(doc_id=i, source="hot" if i % 3 else f"s{r.randrange(12)}", lang=r.choice(["en", None]), n_chars=r.choice([None, i]), text=r.choice([None, "", "a\nb", "é\n\n", f"t{i}"])) for i in range(120)]
    rows += [dict(doc_id=5, source="hot", lang=None, n_chars=None, text="other")] + [dict(doc_id=None, source=None, lang=None, n_chars=None, text="a\nb")] * 4
    rows += [dict(doc_id=1000, source="", lang="en", n_chars=1, text="word " * 50000 + "\n")] + [dict(doc_id=7, source="copies", lang="x", n_chars=0, text="same\n")] * 30
    assert got(merkle.proofs(frame(spark, rows))) == brute(rows)


def test_small_tables(spark):
    one = [dict(doc_id=1, source="a", lang=None, n_chars=3, text="x\ny")]
    assert got(merkle.proofs(frame(spark, one, 1))) == brute(one)
    assert merkle.proofs(frame(spark, one).limit(0)).collect() == []


def test_requests(spark):
    """Some requested leaves have the paths that they have among all."""
    rows = [dict(doc_id=i, source="ab"[i % 2], lang=None, n_chars=i, text=str(i)) for i in range(40)]
    m = merkle.manifest(frame(spark, rows))
    wanted = m.leaves.where("doc_id % 7 = 0").select("tree", "rank")
    every = {(r.tree, r.rank): r for r in merkle.paths(m).collect()}
    some = {(r.tree, r.rank): r for r in merkle.paths(m, wanted).collect()}
    assert len(some) == 6 and all(every[k] == v for k, v in some.items())
