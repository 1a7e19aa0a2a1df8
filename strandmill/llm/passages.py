"""Substring deduplication with repeated-phrase automata.

1. Equal texts are one class.  A minimizer scheme picks anchors, phrases of 16 words, such that every window of 35 words
   contains the anchor with its smallest phrase hash; equal windows have equal anchors.  Anchors that occur once are dropped.
2. Around each remaining anchor the words of all windows that contain it are cut out as a context; a window outside of all
   contexts occurs once.  Windows are counted by their own and their anchor's hash over all contexts; those that occur at
   least twice are candidates, each with the words and the place of its first occurrence.
3. Candidates are dealt to shards by anchor; each shard compiles an Aho-Corasick automaton over word sequences and streams
   every context of its anchors.  An occurrence, word by word, at any other place than the candidate's own confirms that the
   passage recurs, and both places are located; equal hashes alone remove nothing.  A shard with many contexts is salted:
   its automaton is compiled in several tasks, so a phrase in every document splits as well.
4. The words that located windows cover are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.lineage import cut, discard, store
from strandmill.llm.common import extend, narrow, row_key, shield, table, tidy
from strandmill.llm.kernels import SPACE_SEPARATED, mix64, slices, word_hashes

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STEP = 0xD1342543DE82EF95
#: Recurring windows of one automaton and contexts of one task's share of a shard.
_SHARD_WINDOWS, _SHARD_CONTEXTS = 400, 1500

_KEYS = ["__key_a", "__key_b"]


def phrase_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` consecutive words."""
    size = len(words) - length + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(length):
        out = out * np.uint64(_STEP) + words[k : k + size]
    return mix64(out)


def anchors(words: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For each window the place of its anchor, the smallest phrase hash; an equal earlier choice stays while it is inside."""
    hashes = phrase_hashes(words, phrase)
    span = window - phrase + 1
    if len(hashes) < span:
        return np.empty(0, dtype=np.int64)
    out = np.empty(len(hashes) - span + 1, dtype=np.int64)
    for first in range(0, len(out), 50_000):
        part = hashes[first : first + 50_000 + span - 1]
        low = np.lib.stride_tricks.sliding_window_view(part, span).argmin(axis=1)
        out[first : first + len(low)] = low + np.arange(len(low)) + first
    moved = np.flatnonzero((out[1:] != out[:-1]) & (hashes[out[1:]] == hashes[out[:-1]]))
    if len(moved):
        for i in range(int(moved[0]) + 1, len(out)):
            if out[i - 1] >= i and hashes[out[i - 1]] == hashes[out[i]]:
                out[i] = out[i - 1]
    return out


def _documents(texts: list[str | None]) -> Iterator[np.ndarray]:
    for part in slices(texts):
        words, offsets = word_hashes(texts[part], SPACE_SEPARATED, lower=False)
        for first, last in zip(offsets[:-1], offsets[1:], strict=True):
            yield words[first:last]


def _pick(window: int, phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for words in _documents(batch["text"].tolist()):
                chosen = np.unique(anchors(words, window, phrase))
                found.append(phrase_hashes(words, phrase)[chosen].view(np.int64) if len(chosen) else None)
            yield batch.drop(columns="text").assign(phrases=found)

    return run


def _contexts(window: int, phrase: int):
    """Cuts out the contexts of recurring anchors, with the hashes of the windows that each of them owns."""
    columns = ["class", "phrase", "begin", "words", "windows"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            rows = zip(batch["class"], batch["text"], batch["recurring"], strict=True)
            for (of, text, recurring), words in zip(rows, _documents(batch["text"].tolist()), strict=True):
                owner = anchors(words, window, phrase)
                hashes = phrase_hashes(words, phrase).view(np.int64)
                whole = phrase_hashes(words, window).view(np.int64)
                mine = np.flatnonzero(np.isin(hashes[owner], recurring))
                if not len(mine):
                    continue
                written = _WORD.findall(text)
                edges = np.flatnonzero(np.diff(owner[mine], prepend=-1, append=-1))
                for first, last in zip(edges[:-1], edges[1:], strict=True):
                    begin, end = int(mine[first]), int(mine[last - 1])
                    cut_out = " ".join(written[begin : end + window])
                    out.append((of, int(hashes[owner[mine[first]]]), begin, cut_out, whole[begin : end + 1]))
                    if len(out) >= 5000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    return run


def _locate(window: int):
    def run(_: tuple, patterns: pd.DataFrame, contexts: pd.DataFrame) -> pd.DataFrame:
        ids: dict[str, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        classes, starts = [], []
        for of, begin, text, places in zip(patterns["class"], patterns["begin"], patterns["words"], patterns["places"], strict=True):
            words = [ids.setdefault(w, len(ids) + 1) for w in text.split(" ")]
            for place in places:
                automaton.add_word(tuple(words[place : place + window]), len(classes))
                classes.append(of)
                starts.append(begin + place)
        out = []
        if classes and len(contexts):
            automaton.make_automaton()
            own_class, own_start, confirmed = np.array(classes), np.array(starts), np.zeros(len(classes), dtype=bool)
            known: dict[str, int] = {}  # copies have contexts in common
            found, number = [], []
            for text in contexts["words"]:
                if text not in known:
                    known[text] = len(found)
                    stream = tuple([ids.get(w, 0) for w in text.split(" ")])
                    found.append(np.array(list(automaton.iter(stream)), dtype=np.int64).reshape(-1, 2))
                number.append(known[text])
            ends, which = np.concatenate([found[k] for k in number]).T
            row = np.repeat(np.arange(len(number)), [len(found[k]) for k in number])
            of, at = contexts["class"].to_numpy()[row], ends - window + 1 + contexts["begin"].to_numpy()[row]
            other = (own_class[which] != of) | (own_start[which] != at)
            confirmed[which[other]] = True
            of, at = np.append(of[other], own_class[confirmed]), np.append(at[other], own_start[confirmed])
            order = np.lexsort((at, of))
            of, at = of[order], at[order]
            # runs of words that windows cover, and where the runs of each class begin
            first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] - at[:-1] > window))[: len(of)])
            spans = np.stack([at[first], at[np.append(first[1:], len(at))[: len(first)] - 1] + window], axis=1)
            edges = np.flatnonzero(np.diff(of[first], prepend=-1, append=-1)) if len(first) else []
            out = [(of[first[a]], spans[a:b].ravel()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(out, columns=["class", "spans"])

    return run


def _remove(window: int):
    def run(texts: pa.Array, copied: pa.Array, located: pa.Array) -> tuple[list, list, list]:
        kept, n_words, n_removed = [], [], []
        for text, copies, spans in zip(texts.to_pylist(), copied.to_pylist(), located.to_pylist(), strict=True):
            words = _WORD.findall(text) if text is not None else []
            total = len(words)
            if copies and total >= window:
                words = []
            elif spans:
                stay = np.ones(total, dtype=bool)
                for part in spans:
                    for low, high in zip(part[::2], part[1::2], strict=True):
                        stay[low:high] = False
                words = [words[i] for i in np.flatnonzero(stay)]
            kept.append(None if text is None else " ".join(words))
            n_words.append(total)
            n_removed.append(total - len(words))
        return kept, n_words, n_removed

    return run


def repeated_spans(classes: DataFrame, texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """(class, spans) of all words in recurring windows; `classes` has each distinct text's anchors, `texts` the texts."""
    spread = classes.select("class", F.explode("phrases").alias("phrase"))
    # an anchor that recurs within one text counts for each of its places
    often = cut(spread.groupBy("phrase").count().where("count > 1").select("phrase"))
    recurring = narrow(spread, often, ["phrase"]).groupBy("class").agg(F.collect_set("phrase").alias("recurring"))
    recurring = cut(recurring.join(classes.select("class", *_KEYS, "doc"), "class"))
    schema = "class long, phrase long, begin long, words string, windows array<long>"
    wide = texts.join(recurring, [*_KEYS, "doc"]).select("class", "text", "recurring")
    contexts = wide.mapInPandas(tidy(_contexts(window, phrase)), schema)
    contexts, path = store(contexts.withColumn("context", F.monotonically_increasing_id()))

    places = contexts.select("phrase", "context", F.posexplode("windows").alias("place", "hash"))
    at = F.min(F.struct("context", "place")).alias("at")
    counted = places.groupBy("phrase", "hash").agg(F.count("*").alias("n"), at).where("n > 1")
    chosen = counted.groupBy("at.context").agg(F.collect_list("at.place").alias("places"))
    patterns = narrow(contexts.select("context", "phrase", "class", "begin", "words"), cut(chosen), ["context"])
    patterns = cut(patterns.drop("context"))
    total = patterns.agg(F.sum(F.size("places"))).first()[0] or 0
    shards = -(-total // _SHARD_WINDOWS) or 1
    shard = F.pmod(F.xxhash64("phrase"), F.lit(shards)).cast("int").alias("shard")
    salts = cut(contexts.groupBy(shard).agg(F.ceil(F.count("*") / _SHARD_CONTEXTS).cast("int").alias("salts")))
    dealt = narrow(patterns.select(shard, "class", "begin", "words", "places"), salts, ["shard"])
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    dealt = dealt.select("shard", every, "class", "begin", "words", "places")
    streams = narrow(contexts.select(shard, "class", "begin", "words"), salts, ["shard"])
    salt = F.pmod(F.xxhash64("class", "begin"), "salts").cast("int")
    streams = streams.select("shard", salt, "class", "begin", "words").toDF("of_shard", "of_salt", "class", "begin", "words")
    located = dealt.groupBy("shard", "salt").cogroup(streams.groupBy("of_shard", "of_salt")).applyInPandas(
        _locate(window), "class long, spans array<long>"
    )
    spans = cut(located.groupBy("class").agg(F.collect_list("spans").alias("spans")))
    discard(texts.sparkSession, path)
    return spans


def drop_repeated_passages(docs: DataFrame, window: int = 35, phrase: int = 16) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts anywhere else.

    Adds `kept_text` (the words that stay, joined by one space), `n_words` and `n_removed` to every row of `docs`.  Words are
    runs of anything but ASCII white space.  A null text has no words and a null `kept_text`.  Each row is a document, also
    where doc_id is null or repeated, so the windows of repeated rows are all removed.  Extra columns of any name pass through;
    columns named like the added ones are replaced.  An empty table gives an empty result.
    """
    added = ["kept_text", "n_words", "n_removed"]
    docs, back = shield(docs, ["doc_id", "text"], added)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    texts = docs.where("text is not null").select(*row_key("text"), doc, "text")
    schema = "__key_a long, __key_b long, doc string, phrases array<long>"
    picked = texts.mapInPandas(tidy(_pick(window, phrase)), schema)
    classes = picked.groupBy(*_KEYS).agg(F.first("phrases").alias("phrases"), F.min("doc").alias("doc"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    spans = repeated_spans(classes.where("phrases is not null"), texts, window, phrase)
    known = classes.select("class", *_KEYS, (F.col("n") > 1).alias("copies")).join(spans, "class", "left").drop("class")
    known = cut(known.where("copies or spans is not null"))
    joined = docs.withColumns(dict(zip(_KEYS, row_key("text"), strict=True))).join(known, _KEYS, "left").drop(*_KEYS)
    out = extend(joined, _remove(window), ["text", "copies", "spans"], "kept_text string, n_words long, n_removed long")
    return out.select(*back, *added)


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_passages(docs)
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_words", "n_removed", kept)


#: Windows are compared by the text of their words.
ORACLE_SQL = r"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS MATERIALIZED (
  SELECT rid, s, array_to_string(w[s + 1 : s + 35], ' ') AS t
  FROM (SELECT rid, w, unnest(range(len(w) - 34)) AS s FROM doc WHERE len(w) >= 35)
), again AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM win JOIN again USING (t)),
word AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS p FROM doc),
kept AS (
  SELECT word.rid, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t
  FROM word ANTI JOIN gone ON word.rid = gone.rid AND word.p = gone.p GROUP BY word.rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (rid)
"""
