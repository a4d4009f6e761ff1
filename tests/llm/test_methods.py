"""Operators against brute force, exact values or held-out accuracy on small fixtures."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from vectorlint.llm import attention, bpe, components, decontaminate, fingerprint, langid, license, lmscore, neardup, sharding, toxicity, urlfilter, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(UP))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, percent=80, n=4):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def families(seed):
    """Groups of edited copies, so that links chain and long lists stay mixed."""
    r, texts = random.Random(seed), {}
    for _ in range(4):
        base = [f"w{r.randrange(400)}" for _ in range(80)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
            texts[len(texts)] = " ".join(w)
    texts |= {len(texts) + i: f"lone {i} text {i * i} of its own {i}" for i in range(20)}
    return texts


@pytest.mark.parametrize("short", [2, 32])
def test_near_duplicates(spark, monkeypatch, short):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = families(short)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_long_path(spark):
    r = random.Random(1)
    order = list(range(300))
    r.shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(300)} | {500: 500, 501: 500}


def test_word_hashes():
    texts = ["a b  c", "A\tB\nC", "b a c", "", " ", "Éa éa"]
    h = [words.word_hashes(t).tolist() for t in texts]
    assert h[0] == h[1] and sorted(h[0]) == sorted(h[2]) and h[0] != h[2] and h[3] == h[4] == [] and h[5][0] != h[5][1]
    assert len(words.shingles(words.word_hashes("a b"), 4)) == 1 and len(words.shingles(words.word_hashes("a b c d e"), 4)) == 2


def naive_tiles(doc, item, least):
    used_d, used_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and d + k not in used_d and i + k not in used_i:
                    k += 1
                best = max(best, (k, -d, -i))
        k, d, i = best[0], -best[1], -best[2]
        if k < least:
            return total
        used_d |= set(range(d, d + k))
        used_i |= set(range(i, i + k))
        total += k


def test_greedy_tiles():
    r = random.Random(3)
    for _ in range(200):
        item = [r.randrange(6) for _ in range(r.randrange(3, 25))]
        doc = [r.randrange(6) for _ in range(r.randrange(0, 40))]
        tiles = decontaminate.greedy_tiles(doc, item, 3)
        for k, side in ((0, doc), (1, item)):
            places = [p for t in tiles for p in range(t[k], t[k] + t[2])]
            assert len(places) == len(set(places))
        assert all(doc[d:d + n] == item[i:i + n] and n >= 3 for d, i, n in tiles)
        # Nothing of the least length is left unmarked.
        left_d = {p for d, _, n in tiles for p in range(d, d + n)}
        left_i = {p for _, i, n in tiles for p in range(i, i + n)}
        assert not any(doc[d:d + 3] == item[i:i + 3] and not left_d & set(range(d, d + 3)) and not left_i & set(range(i, i + 3)) for d in range(len(doc) - 2) for i in range(len(item) - 2))
        assert abs(sum(n for *_, n in tiles) - naive_tiles(doc, item, 3)) <= 6


def test_leaks(spark):
    item = " ".join(f"b{i}" for i in range(40))
    parts = item.split()
    reordered = " ".join(["x y", *parts[20:], "z", *parts[:20]])
    noisy = "### ".join(parts).upper()
    docs = [(1, f"before {item} after"), (2, reordered), (3, noisy), (4, " ".join(parts[:10]) + " and then other words"), (5, "nothing of it"), (6, " ".join(reversed(parts)))]
    got = decontaminate.contaminated_pairs(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, item), (8, "some other item of words here")], "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id, r.covered) for r in got} == {(1, 9, 40), (2, 9, 40), (3, 9, 40)}


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.predict_languages(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_restored_words():
    text = " ".join(["you idiot you worthless pathetic loser clown trash scum moron stupid the other day was fine"] * 30)
    c = np.concatenate([[0, 0], toxicity._text_codes(text), [0]])
    counts = np.zeros(toxicity._N ** 3)
    np.add.at(counts, (c[:-2] * toxicity._N + c[1:-1]) * toxicity._N + c[2:], 1)
    r = toxicity.Restorer.of(counts.reshape(toxicity._N, toxicity._N, toxicity._N))
    for written, clean in [("1d10t", "idiot"), ("p@thet1c", "pathetic"), ("w o r t h l e s s", "worthless"), ("c.l.o.w.n", "clown"), ("loooooser", "loser"), ("$cum", "scum"), ("tr4$h", "trash"), ("m0r0n", "moron")]:
        assert clean in r.words(f"well {written} then"), written
        assert clean in r.text(f"well {written} then")
    assert r.text("The OTHER day was fine.") == "the other day was fine."


def test_toxicity_held_out(spark):
    r = random.Random(8)
    plain = [f"{a}{b}" for a in "ka lo mi ne pu ra".split() for b in "da fe gi ho ju".split()]
    rude = ["gribbled", "snorkful", "wazzock"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        w = [r.choice(plain) for _ in range(40)]
        if toxic:
            w[r.randrange(40)] = r.choice(rude).replace("o", "0").upper() if i % 8 else r.choice(rude)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and x.predicted == (x.score >= 0.7) for x in got)
    assert sum(x.predicted == labels[x.doc_id][1] for x in held) >= 0.97 * len(held)


def test_windows_score_each_id_once():
    starts = np.array([0, 2, 2 + 30, 32 + 33, 65 + 34, 99 + 200])
    at, scored, text = attention.windows(np.zeros(starts[-1], int), starts)
    hits = collections.Counter((at[scored] + 1).tolist())
    assert set(hits.values()) == {1} and set(hits) == set(range(starts[-1])) - set(starts[:-1].tolist())
    assert all((at[k][scored[k]] >= starts[t]).all() and (at[k][scored[k]] + 1 < starts[t + 1]).all() for k, t in enumerate(text))


def test_attention_gradients_and_distribution():
    r = np.random.default_rng(0)
    n = 200
    ids = r.integers(0, n, 120)
    starts = np.array([0, 50, 120])
    counts = np.bincount(ids, minlength=n).astype(float)
    m = attention.fit(ids, starts, counts, np.arange(n) % 2 == 0, epochs=1, batch=4)
    # A proper distribution: over all ids, the probability of the next id adds up to 1.
    at, scored, _ = attention.windows(np.zeros(3, int), np.array([0, 3]))
    total = sum(np.exp(m.log_probabilities(np.array([5, x, 7]), at, scored)[1]) for x in range(n))
    assert abs(total - 1) < 1e-4
    p = {k: v.astype(np.float64) for k, v in m.p.items()}
    at, scored, _ = attention.windows(ids, starts)

    def loss(q):
        w = attention.Model(q, m.of, np.zeros(n)).tables()
        w.table, w.place = w.table.astype(np.float64), w.place.astype(np.float64)
        return -w.log_probabilities(ids, at, scored).sum() / scored.sum()

    g = attention._gradients(p, m.of, ids, at, scored)
    for k in ("P", "Q", "K", "V", "A", "U", "u", "a"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-3, k


@pytest.mark.parametrize("common", [50, 1 << 20])
def test_lm_base_scores(spark, sf, monkeypatch, common):
    monkeypatch.setattr(lmscore, "COMMON_WORDS", common)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: WORD.findall((r.text or "").translate(UP)) for r in docs.collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = collections.Counter(w for i in train for w in [*texts[i], None])
    n, v = sum(counts.values()), len(counts)
    for r in lmscore.score_texts(docs).collect():
        t = [*texts[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), n, r.doc_id not in train)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0


def test_fingerprints(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprint, "RUN_ROWS", 15)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    errors, prints = [], {}
    for r in fingerprint.fingerprints(docs).collect():
        t = texts[r.doc_id]
        k = len(t) // 3
        edited = t[:len(t) - k] + texts[after[r.doc_id]][:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        for near, other in ((r.near_edited, edited), (r.near_next, texts[after[r.doc_id]])):
            a, b = (set(zip(*[x.lower().split()[i:] for i in range(5)])) for x in (t, other))
            if len(a) > 20 and len(b) > 20:
                errors.append(near - len(a & b) / len(a | b))
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.01


def test_sharding_hot_key(spark):
    docs = spark.range(200).selectExpr("7L AS doc_id", "repeat('x', 100) AS text").union(spark.range(100).selectExpr("id AS doc_id", "repeat('y', cast(id AS int)) AS text"))
    got = sharding.assign_shards(docs, 1500).collect()
    size, rows = collections.Counter(), collections.Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        rows[r.shard] += 1
        assert len(r.shard) == r.depth
    assert len(got) == 300 and all(size[s] <= 1500 or rows[s] == 1 for s in rows)
    assert all(size[r.shard] == r.shard_bytes and rows[r.shard] == r.shard_rows for r in got)
    names = sorted(rows)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_mined_rules(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        tokens = sorted({r.choice(["a", "b", "c"]), r.choice(["d", "e"]), r.choice(["f", "g", "h"])})
        rows.append((tokens, "a" in tokens and "d" in tokens and r.random() < 0.95))
    got = {tuple(x.antecedent): round(x.confidence, 6) for x in urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()}
    found = {}
    for k in (1, 2, 3):
        for c in itertools.combinations("abcdefgh", k):
            fit = [b for t, b in rows if set(c) <= set(t)]
            if fit and sum(fit) >= 25 and sum(fit) / len(fit) >= urlfilter.MIN_CONFIDENCE:
                found[c] = sum(fit) / len(fit)
    kept = {c: round(p, 6) for c, p in found.items() if not any(set(x) < set(c) and q >= p for x, q in found.items())}
    assert got == kept and ("a", "d") in kept


def test_licences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([
        (9001, "intro\nSPDX-License-Identifier: MPL-2.0\nend", "en", "x", 1), (9002, "He has a driver's license and permission, mit der version 2.0.", "en", "x", 1),
        (9003, "THIS WORK IS LICENSED UNDER CC BY-SA 4.0!", "en", "x", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = {(r.doc_id, r.paragraph_index): r.family for r in license.scan(docs).collect()}
    fixed = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    want = {(r.doc_id, k): fixed[p] for r in docs.collect() for k, p in enumerate(r.text.split("\n")) if p in fixed}
    assert got == want | {(9001, 1): "mpl-2.0", (9003, 0): "cc-by-sa"}


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    left = {r.doc_id: rows[r.doc_id] for r in scores if r.score < 0.7}
    left = {i: t for i, t in left.items() if any(c.isalpha() for c in t)}
    found = brute_components(left)
    left = {i: t for i, t in left.items() if found[i][1] == i}
    token = re.compile(r"[^\W_]+").findall
    items = [token(r.text.casefold()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(" " + " ".join(x) + " " in " " + " ".join(token(t.casefold())) + " " for x in items)}
    own = bpe.ForcedBoundaryBPE()
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256(np.array(own.encode(t), "<u4").tobytes()).hexdigest() for i, t in left.items()}


def test_lm_scores_learn_from_all_texts(spark, monkeypatch):
    """However the rows lie, all training texts teach the head, once each."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("the of and house river stone green walks over".split()) for _ in range(12))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(lmscore, "PART_IDS", 3000)
    monkeypatch.setattr(lmscore, "MAX_PASSES", 1)
    seen, parts = [], lmscore._parts
    monkeypatch.setattr(lmscore, "_parts", lambda texts, n: seen.append((texts.count(), parts(texts, n).selectExpr("sum(size(texts))").first()[0])) or parts(texts, n))
    one, many = ({x.doc_id: x.score for x in lmscore.score_texts(docs.repartition(n)).collect()} for n in (1, 7))
    assert seen == [(n := sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(900)), n)] * 2
    assert one == pytest.approx(many, rel=1e-9)


def test_toxicity_long_tail(spark):
    """120 rude words, each in under 1% of the toxic texts."""
    r = random.Random(9)
    plain = [f"{a}{b}" for a in "ka lo mi ne pu ra".split() for b in "da fe gi ho ju".split()]
    rude = [f"{a}{b}{c}" for a in "zax wob gru sny quo".split() for b in "ebb ilk urt osh".split() for c in "en um ox ay id ut".split()]
    texts = [(1, w) for w in rude for _ in range(16)] + [(0, None)] * 5000
    rows = [(i, " ".join([*(r.choice(plain) for _ in range(12)), *([w] if w else [])])) for i, (_, w) in enumerate(texts)]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, (y, _) in enumerate(texts)], "doc_id bigint, toxic int")).collect()
    held = [x for x in got if x.held_out]
    assert sum(x.predicted for x in held if texts[x.doc_id][0]) >= 0.95 * sum(texts[x.doc_id][0] for x in held)
    assert not any(x.predicted for x in held if not texts[x.doc_id][0])


def test_restored_sentences():
    """Spaced runs and tokens of several words, of any length."""
    text = " ".join(["such a fool and you idiot you worthless pathetic loser are i think the other day was fine"] * 30)
    c = np.concatenate([[0, 0], toxicity._text_codes(text), [0]])
    counts = np.zeros(toxicity._N ** 3)
    np.add.at(counts, (c[:-2] * toxicity._N + c[1:-1]) * toxicity._N + c[2:], 1)
    r = toxicity.Restorer.of(counts.reshape(toxicity._N, toxicity._N, toxicity._N))
    sentence = "you worthless pathetic loser and you idiot " * 5
    for written, clean in [("such a f o o l", "fool"), ("y o u i d i o t", "you idiot"), ("y.0.u.1.d.i.o.t", "you idiot"), (" ".join(sentence.replace(" ", "")), sentence),
                           (".".join(sentence.replace(" ", "")), sentence), ("  ".join(" ".join(w) for w in sentence.split()), sentence)]:
        assert set(clean.split()) <= r.words(written), written
        assert clean.strip() in r.text(written)


def test_spaced_words_teach_no_gaps(spark):
    plain = "such a fool and you idiot are i think the other day"
    rows = spark.createDataFrame([(plain,), ("f o o l",), (None,)], "text string")
    counts = toxicity.trigram_counts(rows)
    gaps = toxicity.trigram_counts(rows.limit(1) if rows.first().text == plain else rows)
    assert counts[0, :, 0].sum() - gaps[0, :, 0].sum() == 0


def test_licence_bodies_and_spellings(spark, sf):
    """Bodies without a name, glued versions, missing articles and wrapped lines."""
    mit = license.BODIES["mit"][0].split()
    odd = {1: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", 0),
           2: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd", 0),
           3: ("intro\n\nReleased under GPLv3.", "gpl-3.0", 2), 4: ("Licensed under LGPLv2.1.", "lgpl", 0), 5: ("This program is free software under AGPLv3.", "agpl-3.0", 0),
           6: ("Released under GNU General Public License v3.0.", "gpl-3.0", 0), 7: ("One line.\nThis work is licensed under the Apache\nLicense, Version 2.0.", "apache-2.0", 1),
           8: ("\n".join(" ".join(mit[i:i + 9]) for i in range(0, len(mit), 9)), "mit", 0)}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, (t, _, _) in odd.items()], "doc_id bigint, text string"))
    got = sorted((r.doc_id, r.family, r.paragraph_index) for r in license.scan(docs).collect() if r.doc_id > 9000)
    assert got == [(9000 + i, f, k) for i, (_, f, k) in odd.items()]


def test_mined_rules_of_four_tokens(spark):
    """Only four tokens together come with the label."""
    rows = [([f"{t}{x}" for t, x in zip("abcd", bits)], all(bits)) for bits in itertools.product((0, 1), repeat=4) for _ in range(30)]
    got = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")).collect()
    assert [(r.antecedent, r.confidence) for r in got] == [(["a1", "b1", "c1", "d1"], 1.0)]


def test_sharding_hot_key_just_over(spark):
    """A hot bucket a little over the limit is split bit by bit: no two sister shards would fit as one."""
    docs = spark.range(101).selectExpr("7L AS doc_id", "repeat('x', 100) AS text")
    got = {r.shard: r.shard_bytes for r in sharding.assign_shards(docs, 10000).collect()}
    assert sum(got.values()) == 10100 and len(got) == 2
    docs = spark.range(1000).selectExpr("id % 2 AS doc_id", "repeat('x', 100) AS text")
    got = {r.shard: r.shard_bytes for r in sharding.assign_shards(docs, 10000).collect()}
    assert all(got[s] + got[t] > 10000 for s in got for t in [s[:-1] + "10"[int(s[-1])]] if t in got)


def test_licence_wrapped_over_many_lines(spark, sf):
    """A notice of seven lines inside a longer paragraph of prose is found where it stands."""
    mit = license.BODIES["mit"][1].split()
    text = "\n".join(["we walked along the river", "and saw some boats", *(" ".join(mit[i:i + 3]) for i in range(0, len(mit), 3)), "after lunch we went home", "it was a long day"])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, text)], "doc_id bigint, text string"))
    got = [(r.family, r.paragraph_index, r.paragraph.count("\n") + 1) for r in license.scan(docs).where("doc_id = 9001").collect()]
    assert [g[0] for g in got] == ["mit"] and got[0][1] <= 2 and got[0][2] >= 7


def test_full_sets_are_written_where_they_are_made(spark, monkeypatch):
    plans, write = {}, neardup.materialize

    def kept(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(neardup, "materialize", kept)
    base = "a long enough text of some words that differ from all the others in this little corpus of rows".split()
    rows = [(k, " ".join([*base, f"end{k // 2}"])) for k in range(6)] + [(6, "quite another text"), (0, " ".join([*base, "end0"])), (7, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(0, 0), (0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 6), (7, 7)]
    assert "MapInArrow" in plans["sets"] and "Exchange" not in plans["sets"] and "Join" not in plans["sets"]


def test_near_duplicates_send_no_postings_to_the_driver(spark, monkeypatch):
    """What an exploded signature gives, or ids from a small file, is not broadcast, however small Spark takes it."""
    plans, write = {}, neardup.materialize

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(neardup, "materialize", kept)
    monkeypatch.setattr(neardup, "SHORT", 2)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "FAMILIES", 0)
    texts = families(2)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts)
    joins = {name: [line for line in plans[name].splitlines() if "BroadcastHashJoin" in line] for name in ("postings", "lists")}
    assert joins == {"postings": [], "lists": []}


def test_components_broadcast_no_edges(spark, monkeypatch):
    """The minima may be broadcast, not the edges beside them, though their file is the smaller one."""
    plans, write = [], components.materialize

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(components, "materialize", kept)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (7, 7)], "a bigint, b bigint")
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (200, 100)}
    joins = [line for p in plans for line in p.splitlines() if "Join " in line and "[u" in line]
    assert joins and all("LeftOuter, BuildRight" in line or "SortMergeJoin" in line and "LeftOuter" in line for line in joins)
