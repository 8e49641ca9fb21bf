import hashlib
import io
import math
import os
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typolith.llm import brown_lm, decontam, ngram_join, suffix_bwt, weak_labels, zip_warc
from typolith.llm.bytescan import chunks
from typolith.llm.components import components
from typolith.llm.shared import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# -- repeated strings ------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_merged_transforms_find_repeats(shard):
    rng = random.Random(shard)
    pool = [bytes(rng.choices(b"abcdefg ", k=60)) for _ in range(5)]
    strings = [b"".join(rng.choice(pool)[rng.randint(0, 9) :] + bytes(rng.choices(b"xyz", k=rng.randint(0, 20))) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    strings += [b"a" * 100, b"ab" * 45, b"", b"x" * 39]
    n = Counter(s[i : i + 40] for s in strings for i in range(len(s) - 39))
    for s, flags in zip(strings, suffix_bwt.repeated(strings, 40, shard)):
        assert np.flatnonzero(flags).tolist() == [i for i in range(len(s) - 39) if n[s[i : i + 40]] > 1]


@pytest.mark.parametrize("many", [2000, 1])
def test_remove_repeats(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_bwt, "MANY", many)
    rng = random.Random(many)
    pool = ["".join(rng.choices("abcdé ", k=90)) for _ in range(4)]
    texts = [None, "", "short", "Der " * 60, "Der " * 30 + "x" + "Der " * 30, "ab" * 50, "z" * 39, "z" * 40, "q" * 41]
    texts += [rng.choice(pool)[rng.randint(0, 20) :] + "".join(rng.choices("xyz", k=rng.randint(0, 30))) + rng.choice(pool)[: rng.randint(20, 90)] for _ in range(50)]
    rows = [(i if i != 5 else None, t, "n") for i, t in enumerate(texts)] + [(20, texts[20], "n"), (20, texts[21], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_bwt.remove_repeats(df, length=40).collect())
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 40)))
    assert suffix_bwt.remove_repeats(df.limit(0), length=40).count() == 0


# -- classifier ------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_classifier_agrees_with_labels(spark):
    root = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    got = weak_labels.classify(docs).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id")
    right = got.select(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")).alias("a"), F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("int"))).alias("good")).first()
    assert right.a > 0.97 and right.good > 0.98


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.95, 0.9, 0.8]
    v = np.stack([np.where(rng.random(len(good)) < 0.1, 1, np.where(rng.random(len(good)) < a, good * 2, 2 - good * 2)) for a in accuracy], axis=1)
    p, n = np.unique(weak_labels.pattern(v), return_counts=True)
    m = weak_labels.estimate(p, n.astype(float))
    assert m.prior == pytest.approx(0.8, abs=0.03)
    for k, a in enumerate(accuracy):
        assert m.table[1, k, 2] / (1 - m.table[1, k, 1]) == pytest.approx(a, abs=0.04)


def test_sample_of_the_classifier_is_bounded(spark, monkeypatch):
    seen = []
    fit = weak_labels.train
    monkeypatch.setattr(weak_labels, "train", lambda rows: seen.append(len(rows)) or fit(rows))
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text for a third")).otherwise(F.concat(F.lit("some text of number "), F.col("id").cast("string"))).alias("text"))
    assert weak_labels.classify(df, train_rows=300).count() == 3000
    assert 100 < seen[0] < 400


def test_classifier_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "One plain sentence, and then another one. " * 5, 1.0), (3, "One plain sentence, and then another one. " * 5, 1.0)], "doc_id long, text string, score double")
    rows = weak_labels.classify(df).collect()
    assert len(rows) == 4 and len({(r.doc_id, r.score) for r in rows}) == 3
    assert weak_labels.classify(df.limit(0)).count() == 0


# -- decontamination -------------------------------------------------------


def brute_leaks(docs, items, t=0.8):
    out = set()
    for i, item in items:
        w = WORD.findall(ascii_lower(item or ""))
        if len(w) < 5:
            continue
        m = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        size = len(w) - 4
        for d, text in docs:
            v = WORD.findall(ascii_lower(text or ""))
            g = [tuple(v[k : k + 5]) for k in range(len(v) - 4)]
            best = max((sum((Counter(g[s : s + size]) & m).values()) / sum((Counter(g[s : s + size]) | m).values()) for s in range(max(1, len(g) - size + 1))), default=0) if g else 0
            if best >= t - 1e-12:
                out.add((d, i, round(best, 9)))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = ["w%d" % k for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(12, 40)))) for k in range(12)] + [(90, None), (91, "too few words"), (92, "")]
    docs = [(0, None), (1, ""), (2, "Too few words")]
    for k in range(60):
        w = rng.choices(words, k=rng.randint(5, 80))
        if k % 3:
            leak = WORD.findall(items[k % 12][1])
            if k % 2:
                leak[rng.randrange(len(leak))] = "changed"
            w[10:10] = leak if k % 5 else [x.upper() for x in leak]
        docs.append((10 + k, " ".join(w)))
    docs += [(300, items[0][1]), (300, items[0][1]), (301, " ".join(items[1][1].split()[:-1]))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, similarity int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    for limit in (1 << 20, 1):  # one block of items, and one for each
        got = decontam.matches(d, b, limit=limit).collect()
        assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got} == want
        assert sum(r.doc_id == 300 for r in got) == 2
    kept = {r.doc_id for r in decontam.clean(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _, _ in want}
    assert decontam.matches(d.limit(0), b).count() == 0 and decontam.matches(d, b.limit(0)).count() == 0
    assert decontam.clean(d, b.limit(0)).count() == len(docs)


def test_leaks_with_ids_of_any_type(spark):
    text = " ".join(f"w{k}" for k in range(20))
    d = spark.createDataFrame([("a", text, 1, True), (None, text, 2, True), ("c", "other words", 3, True)], "doc_id string, text string, item_id int, leak boolean")
    b = spark.createDataFrame([("x-1", text)], "item_id string, text string")
    got = decontam.matches(d, b).collect()
    assert sorted((r.doc_id or "", r.item_id, r.similarity) for r in got) == [("", "x-1", 1.0), ("a", "x-1", 1.0)]
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [("c", "other words", 3, True)]


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    index = decontam.Index([1], [g])
    _, table = index.near(34)
    for _ in range(300):
        flips = rng.choice(64, decontam.RADIUS, replace=False)
        f = index.prints[0] ^ np.uint64(sum(1 << int(k) for k in flips))
        assert any(table[b, (f >> np.uint64(8 * b)).astype(np.uint8), 0] for b in range(8))


# -- WARC ------------------------------------------------------------------


def test_packages_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é" * 2000, "<p>a</p>", "x" * 300_000]
    rows = [(k, f"http://h/{k}", h, "clash") for k, h in enumerate(html)] + [(6, "http://h/6", html[6], "clash"), (None, None, "<p>a</p>", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").withColumns({c: F.lit(1) for c in ("_best", "_sha", "sha", "best", "id", "n")})
    to = shared_path(spark, "t")
    manifest = zip_warc.write_packages(df.repartition(2), to, package_bytes=400)
    got = zip_warc.read_packages(manifest).collect()
    best = {}
    for i, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(
        (i, len((h or "").encode()), zip_warc.digest((h or "").encode()), "response" if i == best[h or ""] else "revisit", None if i == best[h or ""] else best[h or ""]) for i, _, h, _ in rows
    )
    assert all(r.payload == (html[r.page_id] or "").encode() for r in got if r.record_type == "response")
    assert all(r.url == (None if r.page_id is None else f"http://h/{r.page_id}") for r in got)
    for m in manifest.collect():  # any reader of ZIP archives sees them
        z = zipfile.ZipFile(zip_warc.open_uri(m.path)[1])
        assert z.testzip() is None and set(z.namelist()) == {zip_warc.DATA, zip_warc.INDEX} and all(i.compress_type == 0 for i in z.infolist())
    assert zip_warc.round_trip(df.limit(0)).count() == 0
    least = zip_warc.round_trip(df.where("page_id < 6"), least=9).collect()
    assert all(r.record_type == "response" for r in least)


def test_zip64_directories_are_read():
    out = io.BytesIO()
    w = zip_warc.PackageWriter(out, zip64_from=8)
    for name, body in (("pad", b"p" * 50), (zip_warc.DATA, b"d" * 20), (zip_warc.INDEX, b"")):
        w.begin(name)
        w.add(body)
        w.finish()
    w.close()
    data = out.getvalue()
    assert zipfile.ZipFile(io.BytesIO(data)).read(zip_warc.DATA) == b"d" * 20
    found = zip_warc.open_package(io.BytesIO(data), len(data))
    m = found[zip_warc.DATA]
    assert data[m.start : m.start + m.size] == b"d" * 20 and found[zip_warc.INDEX].size == 0
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/b", b"hello")
        z.comment = b"PK a comment"
    m = zip_warc.open_package(other, len(other.getvalue()))["a/b"]
    assert other.getvalue()[m.start : m.start + m.size] == b"hello"
    with pytest.raises(ValueError):
        zip_warc.open_package(io.BytesIO(b"no package here" * 9), 135)


# -- near duplicates -------------------------------------------------------


def brute_classes(rows, n=5, t=0.8):
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append(frozenset([("short", *w)]) if 0 < len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 18 * len(sets[i] & sets[j]) >= 8 * (len(sets[i]) + len(sets[j])):
                links[i].add(j)
                links[j].add(i)
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i in range(len(rows)):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates(spark, block):
    rng = random.Random(block)
    words = ["w%d" % k for k in range(400)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "one two three")]
    base = [rng.choices(words, k=120) for _ in range(6)]
    for k in range(150):
        w = list(base[k % 6])
        for _ in range(rng.randint(0, 4) * (k % 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((10 + k, " ".join(w)))
    rows += [(None, " ".join(base[0])), (500, "y " * 30_000), (501, "y " * 29_000), (12, rows[8][1])]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, class_id int")
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in ngram_join.jaccard_classes(df, block=block).collect())
    assert got == Counter(brute_classes(rows))
    assert ngram_join.jaccard_classes(df.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    few = ngram_join.fewest_matches(0.8, 1e-6)
    for h, least in zip(range(ngram_join.STEP, ngram_join.HASHES + 1, ngram_join.STEP), few):
        lost = sum(math.comb(h, m) * 0.8**m * 0.2 ** (h - m) for m in range(least))
        assert lost < 1e-4 and least > 0.4 * h


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(2000):
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            break
    alone = {x for p in pairs for x in p} - set(got)
    assert got == {x: r for x, r in root.items() if x not in alone} and all(root[x] == x for x in alone)


# -- language model --------------------------------------------------------


def lm_rows():
    rng = random.Random(1)
    rows = []
    for k in range(200):
        words = ["the", "cat", "sat", "on", "a", "mat."] if k % 2 else ["der", "hund", "lag", "im", "garten", "still."]
        rows.append((k, " ".join(rng.choice(words) if rng.random() < 0.95 else f"rare{rng.randrange(60)}" for _ in range(rng.randint(0, 40)))))
    return [*rows, (500, None), (501, ""), (1, rows[1][1]), (None, "The Cat")]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_language_model(spark):
    rows = lm_rows()
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    tok = [WORD.findall(ascii_lower(t or "")) + [None] for _, t in rows]
    count = Counter(w for (i, _), ts in zip(rows, tok) if not held_out(i) for w in ts)
    total, types = sum(count.values()), len(count)
    for head in (400_000, 4):  # all words travel with the model, or all but a few meet their counts in the join
        model, counts = brown_lm.fit(df.where(brown_lm.training("doc_id")), head=head, words=8, classes=6)
        got = brown_lm.score(df, model, counts).collect()
        assert model.total == total and model.types == types and len(got) == len(rows)
        want = Counter((i, len(ts), sum(count[w] > 0 for w in ts), round(sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ts), 6)) for (i, _), ts in zip(rows, tok))
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        out = [r for r in got if r.doc_id is not None and held_out(r.doc_id)]
        model_bits = sum(r.score for r in out) / sum(r.n_tokens for r in out)
        plain = [math.log10((count[w] + 1) / (total + types + 1)) for (i, _), ts in zip(rows, tok) if i is not None and held_out(i) for w in ts]
        assert model_bits > sum(plain) / len(plain)


def test_probabilities_sum_to_one(spark):
    rows = lm_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = brown_lm.fit(df, words=8, classes=6)
    assert np.allclose((10**model.after).sum(axis=1), 1)
    mass = np.zeros(6)
    u = model.units
    for r in counts.collect():
        place = u.find(np.array([r.h]))
        mass[model.label[u.of(place, np.array([r["shape"]]))[0]]] += r.c + model.delta
    mass[model.label[-1]] += model.ends + model.delta
    assert np.allclose((mass + model.delta) / 10**model.room, 1)


def test_base_probabilities_sum_to_one(spark):
    texts = ["a a b", "b c", "d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = brown_lm.fit(df, words=4, classes=3)
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "unseen"), (5, "")], df.schema)
    got = {r.doc_id: 10**r.base_score for r in brown_lm.score(asked, model, counts).collect()}
    assert math.isclose(sum(got[k] / got[5] for k in range(5)) + got[5], 1)


def test_gain_of_a_move_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 9, (14, 14)).astype(float)
    label = rng.integers(0, 5, 14)
    one = np.eye(5)[label]
    big = one.T @ n @ one
    for v in range(14):
        for b in range(5):
            new = label.copy()
            new[v] = b
            to = np.eye(5)[new]
            want = brown_lm.likelihood(to.T @ n @ to) - brown_lm.likelihood(big)
            got = brown_lm.move_gain(big, (n[v] @ one)[None], (n[:, v] @ one)[None], n[v, v][None], label[[v]], np.array([b]))
            assert math.isclose(got[0], want, abs_tol=1e-7)


def test_neighbours_and_exchange_over_the_table(spark):
    rows = lm_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = brown_lm.word_counts(df).cache()
    u = brown_lm.frequent(counts, 400_000, 8, tokens=3000)
    table = brown_lm.neighbours(df, u)
    want = np.zeros((u.n, u.n))
    for _, t in rows:
        c = next(chunks(pa.array([t], pa.string())))
        seq = [u.n - 1, *brown_lm._sequence(c, u)[3]]
        for a, b in zip(seq, seq[1:]):
            want[a, b] += 1
    assert (brown_lm.between(table, [np.arange(u.n)], u.n)[0] == want).all()
    label = np.arange(u.n) % 5
    label[-1] = 5
    new, big = brown_lm.climb(table, label, 6)
    one = np.eye(6)[new]
    assert (one.T @ want @ one == big).all() and new[-1] == 5
    assert brown_lm.likelihood(big) > brown_lm.likelihood(np.eye(6)[label].T @ want @ np.eye(6)[label])


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    own = np.arange(12) % 3
    n = rng.integers(0, 3, (13, 13)).astype(np.int64)
    n[:12, :12] += 40 * ((own[:, None] + 1) % 3 == own[None, :])
    label = brown_lm.exchange(n, 4)
    assert all(len(set(label[:12][own == k])) == 1 for k in range(3)) and len(set(label[:12])) == 3 and label[12] == 3


def test_every_word_above_a_small_count_gets_a_class_by_exchange(spark):
    rng = random.Random(2)
    kinds = [[f"{2 * k + s:04d}ab" for k in range(300)] for s in (0, 1)]  # one shape, told apart by their places only
    rows = []
    for k in range(50):
        a, b = (rng.sample(x, len(x)) for x in kinds)
        rows.append((k, " ".join(w for p in zip(a, b) for w in p)))
    model, counts = brown_lm.fit(spark.createDataFrame([*rows, (99, "rare")], "doc_id long, text string"), classes=6)
    u = model.units
    assert u.words == 600 and counts.count() == 601
    own = np.flatnonzero(u.unit >= 0)
    odd = brown_lm.tokens(next(iter(brown_lm.chunks(pa.array([" ".join(kinds[1])])))))[0]
    is_odd = np.isin(u.h[own], odd)
    label = model.label[u.unit[own]]
    assert is_odd.sum() == 300 and not set(label[is_odd]) & set(label[~is_odd])


def test_gain_of_a_move_is_the_rise_of_the_likelihood():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 9, (9, 9)).astype(np.int64)
    start = np.array([0, 1, 2, 0, 1, 2, 0, 1, 3])

    def big(label):
        one = np.eye(4)[label]
        return one.T @ n @ one

    r, l = n @ np.eye(4)[start], n.T @ np.eye(4)[start]
    b, gain = brown_lm.best_moves(big(start), r[:8], l[:8], np.diag(n)[:8].astype(float), start[:8])
    for v in range(8):
        tries = [brown_lm.likelihood(big(np.where(np.arange(9) == v, c, start))) for c in range(3)]
        assert math.isclose(max(tries) - tries[start[v]], gain[v], abs_tol=1e-6) and math.isclose(tries[b[v]], max(tries), abs_tol=1e-6)


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model, counts = brown_lm.fit(empty)
    assert brown_lm.score(empty, model, counts).count() == 0
    one = brown_lm.score(spark.createDataFrame([(1, "a b")], empty.schema), model, counts).first()
    assert (one.n_tokens, one.n_known, one.base_score) == (3, 0, 0.0)


# -- pipeline --------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    import duckdb

    import corpus_pipeline as cp
    from test_extract_mix_rules import brute, fill
    from typolith.llm.queries import OP6_SQL

    assert len(cp.STAGES) == 5 and [len(s) for s in cp.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id < 5"))
    rules, near, leaks, secret, mix = (f for _, f in cp.STAGES)
    a = rules(spark, docs, SF).cache()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({OP6_SQL}) WHERE kept").fetchall()}
    assert a.columns == docs.columns and Counter(r.doc_id for r in a.collect()) == Counter([*kept, *(i for i in range(5) if i in kept)])
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in a.collect():  # what is left are lines of the text, in order
        lines = iter((whole[r.doc_id] or "").split("\n"))
        assert all(any(x == y for y in lines) for x in r.text.split("\n"))
    rows = [(r.doc_id, r.text) for r in a.collect()]
    b = near(spark, a, SF).cache()
    assert b.columns == docs.columns
    assert sorted(r.doc_id for r in b.collect()) == sorted({c for _, c, _, _ in brute_classes(rows)})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _, _ in brute_leaks([(r.doc_id, r.text) for r in b.collect()], items)}
    c = leaks(spark, b, SF).cache()
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect()} - bad
    d = secret(spark, c, SF).cache()
    assert d.columns == docs.columns

    def blotted(t):
        out, at = "", 0
        for lo, _, hi in brute(t):
            if lo >= at and (lo > at or not at):
                out += t[at:lo] + "[SECRET]"
            at = max(at, hi)
        return out + t[at:]

    want = sorted((r.doc_id, blotted(r.text)) for r in c.collect())
    assert sorted((r.doc_id, r.text) for r in d.collect()) == want and all(len(r.text) == r.n_chars for r in d.collect())
    e = mix(spark, d, SF).collect()
    size, own = Counter(), {r.doc_id: len(WORD.findall(r.text)) for r in d.collect()}
    for r in d.collect():
        size[r.source] += own[r.doc_id]
    names = sorted(x for x in size if x is not None) + [x for x in size if x is None]
    target = dict(zip(names, fill([size[x] for x in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    assert sorted((r.doc_id, r.size, r.source_size) for r in e) == sorted((i, n, size[r.source]) for r in d.collect() for i, n in [(r.doc_id, own[r.doc_id])])
    for x in names:
        mine = [r for r in e if r.source == x]
        assert all(r.target == pytest.approx(target[x]) and r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in mine)
        left = target[x] - sum(r.taken for r in mine)
        steps = [left - r.size for r in mine if r.size and r.copies < 2] + [left + r.size for r in mine if r.size and r.copies]
        assert abs(left) <= max(10, 0.01 * target[x]) or all(abs(s) >= abs(left) for s in steps)  # or no copy more or less comes nearer
    assert cp.run(spark, SF).count() == len(e)
