import base64
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow.dataset
import pytest
import sentencepiece
import xxhash
from conftest import EN, FR, prose
from pyspark.sql import functions as F

from strandmill.llm import decontaminate, language, licences, pieces, quality, sharding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


# sharding


def brute_shard(tree, key, seed):
    node, path = tree, ""
    while isinstance(node, dict):
        weights = {n: sharding._weigh(c) for n, c in node.items() if sharding._weigh(c) > 0}
        draws = []
        for name, weight in weights.items():
            h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
            h = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), h)
            if key is not None:
                h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
            draws.append((-np.log(((h & ((1 << 53) - 1)) + 0.5) / (1 << 53)) / weight, name))
        name = min(draws)[1] if len(draws) > 1 else draws[0][1]
        node, path = node[name], f"{path}/{name}"
    return name


def test_shards_against_brute_force(documents, corpus):
    tree = sharding.layout()
    rows = sharding.place(documents, tree).collect()
    for r, (d, t) in zip(sorted(rows, key=lambda r: r["label"]), corpus, strict=True):
        raw = (t or "").encode()
        assert (r["size"], r["law"], r["text_crc32"]) == (len(raw) + 1, "key", None if t is None else __import__("zlib").crc32(raw))
        assert r["shard"] == brute_shard(tree, d, 0) and r["grown_shard"] == brute_shard(sharding.grow(tree), d, 0)
        assert r["grown_shard"] in (r["shard"], 8) and "a b" in r.asDict()


def test_movement_stays_in_changed_subtrees(spark):
    tree = sharding.layout(3, 2, 2)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["region1"]["rack0"][4] = 3.0
    ids = spark.range(20000)
    key = F.col("id")
    moved = ids.select(sharding.shard_of(key, tree, 1).alias("a"), sharding.shard_of(key, heavier, 1).alias("b")).where("a != b")
    for r in moved.collect():
        assert r["b"] in (4, 5, 6, 7)
    share = ids.select(sharding.shard_of(key, heavier, 1).alias("s")).groupBy("s").count().collect()
    assert all(abs(r["count"] / 20000 - (3 if r["s"] == 4 else 1) / 14) < 0.012 for r in share)
    empty = {"a": {"x": {0: 0.0, 1: 1.0}}, "b": {"y": {2: 0.0}}}
    assert {r["s"] for r in ids.select(sharding.shard_of(key, empty).alias("s")).collect()} == {1}


def test_slots_are_gapless(documents, no_documents, monkeypatch):
    monkeypatch.setattr(sharding, "_LEAST_BLOCKS", 3)
    rows = sharding.number_slots(sharding.place(documents, sharding.layout())).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == documents.count() and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.number_slots(sharding.place(no_documents, sharding.layout())).count() == 0


def test_slots_hang_on_rows_alone(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "_ROWS_PER_BLOCK", 40)
    monkeypatch.setattr(sharding, "_LEAST_BLOCKS", 3)
    rows = [(i, f"t{i}", i % 5) for i in range(400)] + [(None, "", 1)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int")
    found = []
    for parts in (1, 7):
        placed = sharding.place(docs.repartition(parts, "number", "text"), sharding.layout())
        out = sharding.number_slots(placed).collect()
        by = {}
        for r in out:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert len(out) == 700 and all(sorted(s) == list(range(len(s))) for s in by.values())
        found.append({r["doc_id"]: (r["shard"], r["slot"]) for r in out if r["doc_id"] is not None})
    assert found[0] == found[1]
    assert sharding.number_slots(sharding.place(documents, sharding.layout())).columns[: len(documents.columns)] == documents.columns


# quality


def junk(seed, size):
    return "".join(f"{w.upper()}!!{'***' if i % 3 else ' '} " for i, w in enumerate(prose(seed, size).split()))


@pytest.fixture(scope="module")
def labelled(spark):
    docs = [(i, (prose if i % 3 else junk)(1000 + i, 20 + i % 60), ["en"] * 9, i) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string, score array<string>, quality long")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    return table, labels


def test_quality_is_learned(labelled, monkeypatch):
    table, labels = labelled
    network = quality.train(table, labels, rows=300)
    out = quality.classify(table.withColumn("held_out", language.held_out()), network).where("held_out").collect()
    good = sum(r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in out)
    assert len(out) > 80 and good / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    text = junk(5, 5000)
    whole = quality.score(network, [text, None, "", text])
    features = np.mean([network.chunk_features(c[None])[0][0] for c in quality.chunked(text)], axis=0)
    assert np.allclose(whole[0], network.probability(features[None])[0]) and whole[0] == whole[3]


def brute_quality(network, text):
    """The score from its definition, byte by byte."""
    data = list((text or "").encode("utf-8", "surrogatepass"))
    span = quality.CHUNK + quality.WIDTH - 1
    data += [0] * (span - len(data))
    starts = list(range(0, len(data) - span + 1, quality.CHUNK))
    if starts[-1] + span < len(data):
        starts.append(len(data) - span)
    pooled = []
    for start in starts:
        sums = [[sum(float(network.filters[k][data[start + i + k]][f]) for k in range(quality.WIDTH)) for i in range(quality.CHUNK)] for f in range(quality.FILTERS)]
        pooled.append([max(0.0, max(s) + float(network.bias[f])) for f, s in enumerate(sums)])
    mean = [sum(p[f] for p in pooled) / len(pooled) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-sum(m * float(w) for m, w in zip(mean, network.weights, strict=True)) - network.offset))


def test_quality_query_against_brute_force(spark, labelled, tmp_path):
    table, labels = labelled
    long = spark.createDataFrame([(9000, prose(9, 3000)), (9001, None), (9002, ""), (9003, "é"), (4, prose(77, 30)), (4, prose(78, 30))], "doc_id long, text string")
    table.select("doc_id", "text").union(long).write.parquet(str(tmp_path / "documents.parquet"))
    labels.union(labels.limit(3)).write.parquet(str(tmp_path / "labels.parquet"))
    found = quality.op4_quality(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    network = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert len(found) == 606
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    some = [r for r in found if r["doc_id"] >= 9000 or r["doc_id"] in (4, 8, 9, 10, 11)]
    assert len(some) == 11
    for r in some:
        assert any(abs(r["score"] - brute_quality(network, t)) < 1e-4 for t in texts[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    unseen = [r for r in found if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in unseen) / len(unseen) > 0.95


def test_training_rows_are_bounded_whatever_repeats(spark, labelled):
    table, labels = labelled
    many = table.select("doc_id", "text").crossJoin(spark.range(3).select(F.col("id").alias("again"))).select("doc_id", F.concat("text", F.col("again").cast("string")).alias("text"))
    seen = []
    original = quality.fit
    try:
        quality.fit = lambda samples, marks: seen.append(len(samples))
        quality.train(many, labels, rows=100)
    finally:
        quality.fit = original
    assert seen == [100]


def test_chunks_cover_the_text():
    for size in (0, 1, 259, 260, 261, 516, 517, 5000):
        text = "".join(random.Random(size).choice("abcdef") for _ in range(size))
        chunks = quality.chunked(text)
        covered = set()
        for c in chunks:
            covered |= {bytes(c[i : i + quality.WIDTH]) for i in range(quality.CHUNK)}
        assert all(text[i : i + quality.WIDTH].encode() in covered for i in range(size - quality.WIDTH + 1))


def test_quality_of_edge_rows(documents, no_documents, labelled):
    network = quality.fit([quality.chunked(prose(1, 50)), quality.chunked(junk(2, 50))], np.array([1, 0], np.float32), epochs=2)
    rows = quality.classify(documents, network).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(no_documents, network).count() == 0
    assert quality.train(no_documents, labelled[1].where("false")) is None
    assert {r["score"] for r in quality.classify(documents, None).collect()} == {0.5}


# pieces


def test_encoding_without_dropout_is_the_models_own():
    codec, own = pieces.Codec(pieces.MODEL, 0.0, 0), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [prose(1, 200), prose(2, 50, FR), "a", "  x  y ", "\n\n", "é一😀 <0x41> <s> </s>", "\t", "aaaaaaaaaaaaaaaaaaaa", "x" * 1000]
    for text, ids in zip(texts, codec.encode(texts, list(range(len(texts)))), strict=True):
        assert ids.tolist() == own.encode(text)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_rounds_follow_the_agenda(dropout):
    codec = pieces.Codec(pieces.MODEL, dropout, 3)
    listed = sorted(set(re.findall(r" +[^ ]*", " " + prose(4, 900) + " 一😀▁é  " + prose(5, 200, FR))))
    many = [np.frombuffer(x, np.int32).tolist() for x in codec.segment_many(listed, 1)]
    assert many == [codec.segment(w, 1) for w in listed]


def test_dropout_varies_and_decodes(documents, corpus, no_documents):
    extra = documents.sparkSession.createDataFrame([(900, "a▁b ▁▁ <0x0A> \x00 😀"), (901, " " * 300 + "z" * 700)], "doc_id long, text string")
    docs = documents.unionByName(extra, allowMissingColumns=True)
    out = pieces.decode(pieces.encode(docs, seed=1)).collect()
    assert all(r["decoded"] == r["text"] for r in out) and len(out) == len(corpus) + 2
    assert {r["tokens"] for r in out if r["text"] is None} == {None}
    again = {(r["doc_id"], r["text"]): r["tokens"] for r in pieces.encode(docs, seed=1).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["tokens"] for r in out)
    other = {(r["doc_id"], r["text"]): r["tokens"] for r in pieces.encode(docs, seed=2).collect()}
    plain = {(r["doc_id"], r["text"]): r["tokens"] for r in pieces.encode(docs, dropout=0.0).collect()}
    long = [k for k in again if k[1] and len(k[1]) > 300]
    assert all(again[k] != other[k] and len(plain[k]) < len(again[k]) for k in long if k[0] not in (81, 82, 901))
    assert pieces.encode(no_documents).count() == 0
    assert len({tuple(c.tolist()) for v in range(2) for c in pieces.Codec(pieces.MODEL, 0.1, 0).encode([prose(1, 300)], [v])}) == 2


def test_every_occurrence_has_draws_of_its_own(spark, monkeypatch):
    codec, text = pieces.Codec(pieces.MODEL, 0.1, 0), " ".join(["international"] * 400 + ["a"] * 20_000)
    found = codec.encode([text, None, text, "x" * 300 + " international " * 50], [5, 6, 7, 8])
    splits = []
    for ids in (found[0], found[2], found[3]):
        whole = b"".join(codec.raw[i] for i in ids).decode()
        marks, at = set(), 0
        for i in ids.tolist():
            marks.add(at)
            at += len(codec.raw[i])
        starts = [m.start() for m in re.finditer(" international", whole)]
        splits.append([tuple(k for k in range(1, 14) if s + k in marks) for s in starts])
    assert [len(x) for x in splits] == [400, 400, 50] and all(len(set(x)) > 8 for x in splits)
    assert found[1] is None and splits[0] != splits[1]
    monkeypatch.setattr(pieces, "_TOGETHER", 1000)  # which words advance together changes nothing
    assert np.array_equal(codec.encode([text], [7])[0], found[2]) and np.array_equal(codec.encode(["x" * 300 + " international " * 50], [8])[0], found[3])
    # " a" is one merge: it is skipped at the dropout rate, wherever it stands
    single = codec.ids[" a"]
    skipped = 1 - np.mean([np.sum(ids == single) / 20_000 for ids in (found[0], found[2])])
    assert 0.09 < skipped < 0.11
    copies = spark.createDataFrame([(i, prose(1, 30)) for i in range(200)] + [(None, prose(1, 30) + "!"), (None, prose(1, 30) + "?")], "doc_id long, text string")
    out = pieces.encode(copies).collect()
    assert len({tuple(r["tokens"][:-1]) for r in out}) == 202


def brute_pieces(own, text, key, seed, dropout):
    """Merge by merge over plain lists: the best-scored merge that isn't skipped, the leftmost among equals."""
    mask, limit = (1 << 64) - 1, int(dropout * (1 << 32))
    odd, piece_odd, mix_a, mix_b = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def mixed(x):
        x &= mask
        x = (x ^ (x >> 30)) * mix_a & mask
        x = (x ^ (x >> 27)) * mix_b & mask
        return x ^ (x >> 31)

    known = {}
    for i in range(own.get_piece_size()):
        if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
            known[own.id_to_piece(i).replace("▁", " ")] = i
    out, base = [], mixed(key + seed * mix_a)
    for position, word in enumerate(re.findall(r" +[^ ]*|[^ ]+", " " + text)):
        drawn = mixed(base + position * odd)
        symbols, places = list(word), list(range(len(word)))
        while True:
            best = None
            for i in range(len(symbols) - 1):
                made = known.get(symbols[i] + symbols[i + 1])
                if made is None:
                    continue
                x = (drawn ^ (places[i] * odd & mask) ^ (made * piece_odd & mask)) * mix_a & mask
                x = (x ^ (x >> 29)) * mix_b & mask
                if x >> 32 >= limit and (best is None or own.get_score(made) > best[0]):
                    best = (own.get_score(made), i)
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2], places[i : i + 2] = [symbols[i] + symbols[i + 1]], [places[i]]
        for x in symbols:
            out += [known[x]] if x in known else [own.piece_to_id(f"<0x{b:02X}>") for b in x.encode("utf-8", "surrogatepass")]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.6])
def test_pieces_against_brute_force(spark, dropout):
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [prose(1, 60), prose(2, 40, FR), "", "a", "  x   y ", "é一😀 <0x41> \n\t tab", "aaaaaaaaaaaaaaaaaaaa", "international " * 9, "z" * 260 + " end"]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pieces.encode(rows.withColumn("k", F.xxhash64(F.lit(4), "doc_id", "text")), dropout=dropout, seed=4).collect()
    for r in found:
        assert r["tokens"] == brute_pieces(own, r["text"], r["k"], 4, dropout), r["text"]


# licences


def brute_base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark, documents, corpus, no_documents):
    mit = next(t for label, _, t in licences.TEMPLATES if label == "mit")
    bsd = next(t for label, _, t in licences.TEMPLATES if label == "bsd")
    texts = [
        "MIT License mit license, Released under the MIT License", "Apache  License", "the GNU General Public License.", "cc-by cc by",
        "Licensed under CC BY-NC 4.0.", "All rights reserved.", "all reserved rights", "mit licenses", "ÀMIT License", None, "", "cc", "gnu general public",
        prose(1, 3000) + " Permission is hereby granted, free of charge, to any person obtaining a copy " + prose(2, 3000),
        "permission is hereby granted", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        mit + " " + prose(4, 50) + "\n" + bsd, "permission is hereby granted free of charge", bsd.replace("binary", "other"),
        " ".join(t for *_, t in licences.TEMPLATES),
    ]
    rows = [(i, t, "mine") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    out = licences.scan_licences(table).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [r["labels"] for r in out[:-1]] == [
        "mit", "apache", "gpl", "cc-by", "cc-by,cc-by-nc", "all-rights-reserved", "", "", "", "", "", "", "", "mit", "", "bsd",
        "bsd,mit", "mit", "",
    ]
    assert set(out[-1]["labels"].split(",")) == {label for label, *_ in licences.TEMPLATES}
    # a label hangs on the row's own text: each text alone gives what it gives among the others
    for r in out[13:17]:
        alone = licences.scan_licences(table.where(F.col("doc_id") == r["doc_id"])).first()
        assert (alone["labels"], alone["score"]) == (r["labels"], r["score"])
    every = licences.scan_licences(documents)
    assert every.columns == [*documents.drop("score").columns, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert Counter((r["doc_id"], r["n_words"]) for r in every.collect()) == Counter((d, len(words(t))) for d, t in corpus)
    assert licences.scan_licences(no_documents).count() == 0


# language


def test_language(spark, documents, no_documents):
    rows = [(i, prose(3000 + i, 15 + i % 50, FR if i % 2 else EN), "fr" if i % 2 else "en") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, per_language=100)
    assert model.languages == ["en", "fr"] and len(model.centroids) == 8
    out = language.predict(table.withColumn("held_out", language.held_out()), model).where("held_out").collect()
    assert len(out) > 70 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert not any(r["rejected"] for r in out) and all(0 <= r["score"] <= 1 for r in out)
    odd = [(0, None), (1, ""), (2, "123 !!"), (3, "一二三四五六七八九十" * 30), (4, prose(1, 40))]
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert [found[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and found[3]["lang_pred"] != "und"
    assert [found[i]["rejected"] for i in range(5)] == [True, True, True, True, False]
    rows = language.predict(documents, model)
    assert rows.count() == documents.count() and rows.columns == [*documents.columns, "lang_pred", "score", "rejected"]
    assert language.train(no_documents) is None and language.predict(no_documents, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(documents, None).collect()} == {"und"}


def test_rejects_unlearned_languages_and_noise_but_not_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    noise = ["".join(rng.choices(string.ascii_lowercase + " ", k=3000)) for _ in range(50)]
    noise += [base64.b64encode(rng.randbytes(2000)).decode() for _ in range(50)]

    def rejected(model, texts):
        return np.mean(language._predict(SimpleNamespace(value=model))(pyarrow.array(texts))[2])

    unseen = [r["text"] for r in docs.where(language.held_out()).collect()]
    whole = language.train(docs)
    assert rejected(whole, unseen) < 0.02 and rejected(whole, noise) == 1
    for size in (16, 60, 200, 500):
        assert rejected(whole, [t[37 : 37 + size] for t in unseen if len(t) > 37 + size]) < 0.03, size
    for left in whole.languages:
        others = language.train(docs.where(F.col("lang") != left))
        assert rejected(others, [r["text"] for r in docs.where(F.col("lang") == left).collect()]) > 0.85, left


def brute_language(model, text):
    """Language and cosine from the definition, n-gram by n-gram."""
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    folded = [x + 32 if 0x41 <= x <= 0x5A else x if 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in text.encode("utf-8", "surrogatepass")]
    data = [0x20]
    for x in [*folded, 0x20]:
        if x != 0x20 or data[-1] != 0x20:
            data.append(x)
    held = Counter()
    for width in (2, 3):
        for i in range(len(data) - width + 1):
            code = width
            for x in data[i : i + width]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ x
            held[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    vector = {d: math.log1p(n) * float(model.idf[d]) for d, n in held.items()}
    size = math.sqrt(sum(v * v for v in vector.values()))
    cosines = [sum(v * float(c[d]) for d, v in vector.items()) / size for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    return model.languages[model.of[best]], cosines[best]


def test_language_query_against_brute_force(spark, tmp_path):
    rows = [(i, prose(3000 + i, 15 + i % 50, FR if i % 2 else EN), ("fr" if i % 2 else "en") if i % 7 else None) for i in range(300)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "12 !", None), (903, prose(1, 4000), "en"), (None, "the of and", "en"), (5, "é à ça", "fr"), (5, "é à ça", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    model = language.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    found = language.op7_language(spark, str(tmp_path)).collect()
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(brute_language(model, t))
    assert len(found) == len(rows)
    for r in found:
        assert any(r["lang_pred"] == lang and abs(r["score"] - min(1, max(0, cosine))) < 1e-4 for lang, cosine in want[r["doc_id"]])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    unseen = [r for r in found if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["lang_pred"] == ("fr" if r["doc_id"] % 2 else "en") for r in unseen) / len(unseen) > 0.98


def test_what_is_learned_is_bounded(spark):
    rows = [(i // 3, f"{prose(i, 30)} {i % 2}", f"l{i % 9}") for i in range(900)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string")
    model = language.train(docs, per_language=5, clusters=8, max_languages=4)
    assert len(model.languages) == 4 and len(model.centroids) <= 20


def test_counts_stay_within_texts():
    texts = ["ab", "cd ef", None, "", "x!!y"]
    together = language.counts(texts)
    assert np.array_equal(together, np.concatenate([language.counts([t]) for t in texts]))


# decontamination


@pytest.mark.parametrize(("size", "limit"), [(13, 200_000), (13, 7), (4, 200_000)])
def test_contamination_against_brute_force(spark, documents, corpus, no_documents, size, limit):
    shared = prose(2, 50)
    items = [(1, shared), (2, " ".join(shared.split()[20:40])), (3, "word"), (4, prose(77, 60)), (5, None), (6, "!!"), (7, "a line"), (None, shared), (10, shared), (1, "alone here")]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_hit string")
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for s in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[s : s + size]), set()).add(i)
    want = Counter()
    for d, t in corpus:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= ids
        listed = sorted(map(str, found))
        want[d, len(w), len(hit), len(found), ",".join(listed), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    rows = decontaminate.find_contamination(documents, table, size, limit).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"]), r["contaminated"]) for r in rows) == want
    assert decontaminate.find_contamination(no_documents, table, size).count() == 0
    none = decontaminate.find_contamination(documents, table.where("false"), size).collect()
    assert len(none) == len(corpus) and not any(r["contaminated"] for r in none)


# the pipeline


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    passage, line = prose(11, 40), "This line is in very many documents."
    rows = [(i, prose(500 + i, 60, FR if i % 2 else EN) + f"\n{line}", "fr" if i % 2 else "en") for i in range(60)]
    rows += [(100, prose(500, 60) + f" more\n{line}", "en"), (101, "123 456", "en"), (102, passage + " " + prose(9, 20), "en"), (103, None, None)]
    # a short passage in a long document, and a text without a label
    rows += [(104, prose(21, 3000) + " " + " ".join(passage.split()[7:21]) + " " + prose(22, 3000), "en"), (105, prose(23, 60, FR), None)]
    full = [(i, t, lang, f"s{i % 3}", None if t is None else len(t)) for i, t, lang in rows]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(full, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "the of")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 105} and out[105]["lang"] == "fr"
    codec = pieces.Codec(pieces.MODEL, 0.1, 0)
    for i, r in out.items():
        text = full[i][1] if i < 60 else full[-1][1]
        assert r["text"] == text.removesuffix(f"\n{line}") == codec.decode(r["tokens"]) and r["n_chars"] == len(r["text"])


def test_pipeline_stages_on_odd_rows(spark, documents, no_documents, corpus, tmp_path):
    """Nulls, empty, long and repeated texts, extra columns of any name, and nothing at all, stage by stage."""
    import corpus_pipeline

    spark.createDataFrame([(1, prose(2, 50)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        out = stage(spark, documents, str(tmp_path))
        assert out.columns == documents.columns + ["tokens", "n_tokens"] * last, name
        kept[name] = {r["label"]: r for r in out.collect()}
        assert all(r["a.b"] == "v12" for r in kept[name].values())
        assert stage(spark, no_documents, str(tmp_path)).count() == 0
    every = set(range(len(corpus)))
    assert set(kept["line_dedup"]) == set(kept["sentencepiece"]) == every
    assert {i for i, (_, t) in enumerate(corpus) if t is None or not t.strip()}.isdisjoint(kept["language_id"])
    first = {}
    for i, (d, t) in enumerate(corpus):
        if d is not None and t and t.split():
            first.setdefault(" ".join(t.split()).lower(), d)
    assert all(corpus[i][0] is None or not (corpus[i][1] or "").split() or first[" ".join(corpus[i][1].split()).lower()] == corpus[i][0] for i in kept["minhash_near_dedup"])
    assert every - set(kept["benchmark_decontamination"]) == {i for i, (_, t) in enumerate(corpus) if prose(2, 50) in (t or "")}


CONTRACTS = {
    "op1_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_passages": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_licences": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_lines": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op10_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_return_the_contracts(spark, name):
    from strandmill.llm import queries

    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found, kinds = out.collect(), dict(out.dtypes)
    wanted = dict(x.rsplit(" ", 1) for x in CONTRACTS[name].split(", "))
    assert {n: kinds[n] for n in wanted} == wanted
    source = "embeddings" if "embeddings" in name else "documents"
    key = "vec_id" if "embeddings" in name else "doc_id"
    ids = pyarrow.dataset.dataset(f"/root/testdata/sf0.001/{source}.parquet").to_table(columns=[key])[key].to_pylist()
    assert Counter(r[key] for r in found) == Counter(ids)
    nullable = {"first_word", "last_word", "text_crc32"}
    assert all(r[n] is not None for r in found for n in wanted if n not in nullable)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        result = con.execute(queries.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(out.columns)
        assert Counter(tuple(r[n] for n in names) for r in found) == Counter(result.fetchall())


def test_pieces_query_is_lossless(spark):
    from strandmill.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = pyarrow.dataset.dataset(f"{folder}/documents.parquet").to_table().to_pylist()
    found = queries.QUERIES["op5_pieces"](spark, folder).collect()
    want = {d["doc_id"]: hashlib.sha256(d["text"].encode()).hexdigest() for d in docs}
    assert {r["doc_id"]: r["decoded_sha256"] for r in found} == want and all(r["lossless"] for r in found)
