import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from strandmill.llm import common, embeddings, kernels, lines, minhash, passages
from strandmill.llm.common import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self):
        self.of = {}

    def find(self, x):
        self.of.setdefault(x, x)
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def shingles(text, width):
    words = SPACE.findall((text or "").translate(LOWER))
    if len(words) >= width:
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def test_word_hashes_follow_the_words():
    texts = ["A b c\x0bA", None, "", " a  B", "é" * 5, "x" * 3_000_000 + " a"]
    hashes, offsets = kernels.word_hashes(texts, kernels.SPACE_SEPARATED, lower=True)
    every = [SPACE.findall((t or "").translate(LOWER)) for t in texts]
    assert offsets.tolist() == np.cumsum([0, *map(len, every)]).tolist()
    seen = {}
    for word, value in zip([w for ws in every for w in ws], hashes.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (50, 50), (7, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 0, 300: 0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("width", "block"), [(2, 512), (5, 512), (2, 3)])
def test_minhash_against_brute_force(documents, corpus, width, block, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
    monkeypatch.setattr(minhash, "SET_BLOCK", block)
    groups, sets = Groups(), [(d, shingles(t, width)) for d, t in corpus]
    for d, s in sets:
        for e, z in sets:
            if None not in (d, e) and s and z and 100 * len(s & z) >= 80 * len(s | z):
                groups.link(d, e)
    want = Counter((d, len(s), d if d is None or not s else groups.find(d)) for d, s in sets)
    rows = minhash.near_duplicates(documents, width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert rows[0].asDict().keys() == {*documents.columns, "n_shingles", "component_id", "kept"}


def test_index_keys_find_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS), dtype=np.uint16)
    two = one.copy()
    for row in two:
        row[rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)] ^= 1
    a, b = minhash.index_keys(one), minhash.index_keys(two)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    tail = sum(math.comb(64, d) * 0.2**d * 0.8 ** (64 - d) for d in range(minhash.RADIUS + 1, 65))
    assert tail < 1e-6


def test_signatures_of_similar_sets_stay_within_the_radius():
    """Pairs of sets at a similarity of exactly 0.8, of real words, are all found by a common key."""
    rng, far = np.random.default_rng(12), []
    for size in (9, 18, 45, 90, 450, 1800):
        for _ in range(100):
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, 11 * size // 9)]
            shared, rest = size * 8 // 9, size // 9
            # 8 parts in common and one part on each side: 8 / 10
            texts = [" ".join(words[:shared] + words[shared + k * rest : shared + (k + 1) * rest]) for k in (0, 1)]
            one, two = (np.array(sorted(minhash.shingle_sets([t], 1).__next__())) for t in texts)
            assert len(np.intersect1d(one, two)) * 100 == 80 * len(np.union1d(one, two))
            signed = minhash.signatures([one, two])
            far.append(int((signed[0] != signed[1]).sum()))
            keys = minhash.index_keys(signed)
            assert set(keys[0].tolist()) & set(keys[1].tolist())
    assert max(far) <= minhash.RADIUS - 3


def test_minhash_of_nothing(no_documents):
    assert minhash.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize(("window", "phrase", "small"), [(35, 16, False), (6, 3, False), (6, 3, True)])
def test_passages_against_brute_force(documents, corpus, window, phrase, small, monkeypatch):
    if small:
        monkeypatch.setattr(passages, "_SHARD_WINDOWS", 20)
        monkeypatch.setattr(passages, "_SHARD_CONTEXTS", 5)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    every = [SPACE.findall(t or "") for _, t in corpus]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    want = Counter()
    for (d, t), w in zip(corpus, every, strict=True):
        stay = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                stay[i : i + window] = [False] * window
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        want[d, len(w), len(w) - len(kept), None if t is None else " ".join(kept)] += 1
    rows = passages.drop_repeated_passages(documents, window, phrase).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows) == want
    assert rows[0].asDict().keys() == {*documents.columns, "kept_text", "n_words", "n_removed"}


def test_equal_hashes_alone_remove_nothing():
    """A candidate whose words stand nowhere else stays, and one that recurs is located at both places."""
    first, other = "a b c d e f", "x b c d e y"
    patterns = pd.DataFrame([(1, 10, first, np.array([1, 2]))], columns=["class", "begin", "words", "places"])
    alone = pd.DataFrame([(1, 10, first)], columns=["class", "begin", "words"])
    both = pd.DataFrame([(1, 10, first), (2, 4, other)], columns=["class", "begin", "words"])
    locate = passages._locate(3)
    assert len(locate((), patterns, alone)) == 0
    found = {r["class"]: r["spans"].tolist() for _, r in locate((), patterns, both).iterrows()}
    assert found == {1: [11, 15], 2: [5, 9]}


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 5000).astype(np.uint64)
    hashes, owner = passages.phrase_hashes(words, 5), passages.anchors(words, 12, 5)
    whole = passages.phrase_hashes(words, 12)
    values = defaultdict(set)
    for i, h in enumerate(whole.tolist()):
        assert i <= owner[i] <= i + 7
        values[h].add(int(hashes[owner[i]]))
    assert all(len(v) == 1 for v in values.values())


def test_passages_of_nothing(no_documents):
    assert passages.drop_repeated_passages(no_documents).count() == 0


def _kept_lines(corpus, min_docs, min_chars=1):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for _, t in corpus]
    often = Counter(k for ks in keys for k in set(ks))
    out = Counter()
    for (d, t), ks in zip(corpus, keys, strict=True):
        gone = [len(k) >= min_chars and often[k] >= min_docs for k in ks]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), gone, strict=True) if not g)
        out[d, len(ks), sum(gone), None if t is None else kept] += 1
    return out


@pytest.mark.parametrize(
    ("min_docs", "min_chars", "bits", "most"),
    [(10, 1, 1 << 28, 1 << 20), (2, 1, 1 << 28, 0), (2, 8, 64, 0), (2, 8, 101, 1 << 20), (2, 1, 5000, 1 << 20)],
)
def test_lines_against_brute_force(documents, corpus, min_docs, min_chars, bits, most, monkeypatch):
    monkeypatch.setattr(lines, "_FAN_IN", 2)
    monkeypatch.setattr(lines, "_SLICE_BITS", 1 << 11)
    monkeypatch.setattr(lines, "_HOT_SHARE", 10)
    rows = lines.drop_repeated_lines(documents, min_docs, min_chars, bits, most).collect()
    found = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows)
    assert found == _kept_lines(corpus, min_docs, min_chars)
    assert rows[0].asDict().keys() == {*documents.columns, "n_lines", "n_dropped"}


def test_filters_hold_what_several_have():
    rng = np.random.default_rng(8)
    every = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    parts = [every[:1000], every[900:2000], every[1990:]]
    filters = []
    for part in parts:
        once, twice = lines.Filter(1 << 16), lines.Filter(1 << 16)
        once.put(once.places(part))
        filters.append((once.data, twice.data))
    once, twice = filters[0]
    for o, t in filters[1:]:
        once, twice = once | o, twice | t | (once & o)
    merged = lines.Filter(1 << 16)
    merged.data = twice
    held = merged.holds(merged.places(every))
    assert held[900:1000].all() and held[1990:2000].all() and held.mean() < 0.2


def test_digests_with_a_half_in_common():
    rows = np.array([(5, 1), (5, 2), (7, 1), (5, 9)], dtype=np.uint64)
    asked = np.array([(5, 9), (5, 3), (7, 1), (8, 8), (5, 1)], dtype=np.uint64)
    assert lines.Digests(rows).holds(asked).tolist() == [True, False, True, False, True]
    assert not lines.Digests(rows[:0]).holds(asked).any()


def test_lines_of_nothing(no_documents):
    assert lines.drop_repeated_lines(no_documents).count() == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(2)
    points = rng.normal(0, 2, (300, 8))
    home = embeddings.decode_e8(points)
    doubled = np.rint(2 * home)
    assert np.array_equal(doubled, 2 * home) and np.all((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1))
    assert np.all(home.sum(axis=1) % 2 == 0)
    for p, h in zip(points, home, strict=True):
        assert ((p - h) ** 2).sum() <= (((p - h) - embeddings._NEAR) ** 2).sum(axis=1).min() + 1e-9
    assert len(embeddings._NEAR) == 240


def vectors():
    rng = np.random.default_rng(4)
    rows, number = [], 0
    for label in (1, 2, None):
        for _ in range(20):
            centre = rng.normal(size=16)
            for _ in range(6):
                rows.append((number, (centre + rng.normal(0, 0.2, 16)).astype(np.float32).tolist(), label))
                number += 1
    one = rows[0][1]
    rows += [(1000 + k, one, 1) for k in range(5)] + [(1010, [2 * x for x in one], 1), (1011, one, 2), (1012, one[:8], 1)]
    rows += [(1020, None, 1), (1021, [0.0] * 16, 1), (1022, [float("nan"), *one[1:]], 1), (1023, [None, *one[1:]], 1)]
    rows += [(1024, [float("inf"), *one[1:]], 1), (1025, [], 1), (None, one, 1)]
    return rows


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "_BLOCK", 4)
    rows = vectors()
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, kept string, n int")
    groups, links = Groups(), Counter()

    def good(v, label, vec):
        clean = None not in (v, label, vec) and all(x is not None and math.isfinite(x) for x in vec)
        return clean and any(vec)

    for v, x, a in rows:
        for w, y, b in rows:
            if v != w and good(v, a, x) and good(w, b, y) and a == b and len(x) == len(y):
                p, q = np.array(x, dtype=float), np.array(y, dtype=float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.93:
                    links[v] += 1
                    groups.link(v, w)
    found = {r["vec_id"]: r for r in embeddings.near_vectors(table).collect()}
    assert len(found) == len(rows)
    total = sum(links.values())
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * total
    assert all(r["n_links"] <= links[v] for v, r in found.items())
    exact = [v for v in found if found[v]["component_id"] == (groups.find(v) if v is not None else None)]
    assert len(exact) >= 0.97 * len(found)
    assert all(found[v]["n_links"] == 0 and found[v]["kept"] for v in (1012, 1020, 1021, 1022, 1023, 1024, 1025, None))
    assert found[1000]["n_links"] == links[1000] and found[1010]["component_id"] == found[1000]["component_id"]
    assert embeddings.near_vectors(table.where("false")).count() == 0


@pytest.mark.parametrize("block", [3, 256])
def test_embedding_query_on_planted_clusters(spark, tmp_path, block, monkeypatch):
    """Dense and drifting clusters under several labels, against all pairs by brute force."""
    monkeypatch.setattr(embeddings, "_BLOCK", block)
    monkeypatch.setattr(embeddings, "_SHARD_ROWS", 200)
    rng, rows = np.random.default_rng(9), []
    for label in (0, 1):
        for spread in (0.05, 0.1, 0.15):
            centre = rng.normal(size=64)
            rows += [(centre + rng.normal(0, spread, 64), label) for _ in range(40)]
        walk = rng.normal(size=64)
        for _ in range(25):
            walk = walk + rng.normal(0, 0.25, 64)
            rows.append((walk, label))
    rows += rows[:6] + [(rng.normal(size=64), 2) for _ in range(50)]
    order = rng.permutation(len(rows))
    full = [(int(order[i]), v.astype(np.float32).tolist(), a) for i, (v, a) in enumerate(rows)]
    spark.createDataFrame(full, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    units = np.array([v for _, v, _ in full], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    labels, ids = np.array([a for *_, a in full]), [i for i, *_ in full]
    near = (units @ units.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    groups = Groups()
    for i, j in zip(*np.nonzero(near), strict=True):
        groups.link(ids[i], ids[j])
    found = {r["vec_id"]: r for r in embeddings.op10_embeddings(spark, str(tmp_path)).collect()}
    want = dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    assert sum(want.values()) > 5000 and len(found) == len(full)
    assert all(found[i]["n_links"] <= n for i, n in want.items())
    assert sum(r["n_links"] for r in found.values()) >= 0.999 * sum(want.values())
    assert np.mean([found[i]["component_id"] == groups.find(i) for i in ids]) > 0.99
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    one = rng.normal(size=(4000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = rng.normal(size=one.shape)
    side -= (side * one).sum(axis=1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    two = 0.93 * one + math.sqrt(1 - 0.93**2) * side
    met = np.zeros(len(one), dtype=bool)
    for (a, pa), (b, pb) in zip(embeddings.cells(one), embeddings.cells(two), strict=True):
        met |= (a == b) | (pa == b[:, None]).any(axis=1) | (pb == a[:, None]).any(axis=1)
    assert met.mean() > 0.995


def test_digests_of_queries(spark, tmp_path, corpus):
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = lines.op9_lines(spark, str(tmp_path)).collect()
    want = Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for (d, _, _, t), n in _kept_lines(corpus, 10).items() for _ in range(n))
    assert Counter((r["doc_id"], r["kept_sha256"]) for r in rows) == want
