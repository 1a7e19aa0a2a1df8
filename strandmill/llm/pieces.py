"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A merge-type (BPE) model is applied with an agenda of candidate merges, best score first and leftmost among equals.  A
candidate that is taken from the agenda is skipped if its keyed hash falls below the dropout rate; the key is the seed,
the document (doc_id and text), the word's position in it, the candidate's place and the piece it would make.  So every
occurrence of a word is segmented by draws of its own, and every run gives the same ids.  The agendas of many words advance
together in numpy, each by its best candidate in a round; very long words have a heap of their own.  Symbols outside the
vocabulary become byte pieces, so decoding always returns the text.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import extend, shield, table
from strandmill.llm.kernels import mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MASK = (1 << 64) - 1
#: The longest word whose agenda advances with others, and about how many characters do so at once.
_LONGEST, _TOGETHER = 200, 1 << 17
_SLOT_BITS = 20
_NEVER = np.int32(2**31 - 1)
_PLACE, _PIECE, _MIX_A, _MIX_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Codec:
    """A model's vocabulary with dropout settings; text is handled with plain spaces in place of the space symbol."""

    def __init__(self, model: str, dropout: float, seed: int) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.seed, self.limit = seed, int(dropout * (1 << 32))
        self.ids: dict[str, int] = {}
        self.rank: list[float] = []
        self.raw: list[bytes] = []
        self.byte: list[int] = [processor.unk_id()] * 256
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            self.rank.append(-processor.get_score(i))
            if processor.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.raw.append(bytes([int(piece[3:-1], 16)]))
            elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
                self.raw.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.ids[text] = i
                self.raw.append(text.encode())
        self._tables()

    def _tables(self) -> None:
        """Arrays for many words at once: symbols of single characters, and every merge by its pair of symbols."""
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        pairs = []
        for text, i in self.ids.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
            for k in range(1, len(text)):
                left, right = self.ids.get(text[:k]), self.ids.get(text[k:])
                if left is not None and right is not None:
                    pairs.append((left * len(self.raw) + right, i))
        # pairs by a slot of their hash; those whose slot is taken are few and looked up by bisection
        codes, makes = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        slots = self._slot(codes)
        _, first = np.unique(slots, return_index=True)
        self.slot_code, self.slot_makes = np.full(1 << _SLOT_BITS, -1, dtype=np.int64), np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self.slot_code[slots[first]], self.slot_makes[slots[first]] = codes[first], makes[first]
        rest = np.setdiff1d(np.arange(len(codes)), first)
        rest = rest[np.argsort(codes[rest])]
        self.rest_code, self.rest_makes = np.append(codes[rest], 1 << 62), np.append(makes[rest], 0)
        self.shared = np.zeros(1 << _SLOT_BITS, dtype=bool)
        self.shared[slots[rest]] = True
        self.order = np.empty(len(self.rank), dtype=np.int32)
        self.order[np.argsort(self.rank, kind="stable")] = np.arange(len(self.rank))

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(_PLACE)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _propose(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of neighbours the order of their candidate, never where there is none or it is skipped, and its piece."""
        code = left.astype(np.int64) * len(self.raw) + right
        slot = self._slot(code)
        there, made = self.slot_code[slot] == code, self.slot_makes[slot]
        other = np.flatnonzero(~there & self.shared[slot])
        at = np.searchsorted(self.rest_code, code[other])
        there[other] = self.rest_code[at] == code[other]
        made[other] = self.rest_makes[at]
        there &= (left >= 0) & (right >= 0)
        if self.limit:
            mixed = key ^ (place.astype(np.uint64) * np.uint64(_PLACE)) ^ (made.astype(np.uint64) * np.uint64(_PIECE))
            mixed = mixed * np.uint64(_MIX_A)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_MIX_B)
            there &= (mixed >> np.uint64(32)) >= self.limit
        return np.where(there, self.order[made], _NEVER), made

    def _advance(self, chars: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many non-empty words and where each word's end; every round merges the best candidate of each word's agenda."""
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        first_char = np.cumsum(lengths) - lengths
        char = np.arange(len(chars), dtype=np.int32)
        symbol = self.symbol[chars]
        inside = np.append(word[1:] == word[:-1], False)
        order, made = self._propose(symbol, np.append(symbol[1:], np.int32(-1)), keys[word], char - first_char[word])
        order[~inside] = _NEVER
        done = []
        while len(word):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(heads, len(word)))
            best = np.repeat(np.minimum.reduceat(order, heads), sizes)
            live = best < _NEVER
            done.append((char[~live], symbol[~live]))
            word, char, symbol, order, made, best = (x[live] for x in (word, char, symbol, order, made, best))
            spots = np.flatnonzero(order == best)
            owner = word[spots]
            spots = spots[np.append(True, owner[1:] != owner[:-1])] if len(spots) else spots
            symbol[spots] = made[spots]
            stay = np.ones(len(word), dtype=bool)
            stay[spots + 1] = False
            word, char, symbol, order, made = (x[stay] for x in (word, char, symbol, order, made))
            spots = spots - np.arange(len(spots))
            for left in (spots, spots[spots > 0] - 1):
                right = np.minimum(left + 1, len(word) - 1)
                same = (word[left] == word[right]) & (left != right)
                found = self._propose(symbol[left], symbol[right], keys[word[left]], char[left] - first_char[word[left]])
                order[left], made[left] = np.where(same, found[0], _NEVER), found[1]
        at = np.concatenate([c for c, _ in done])
        rank = np.argsort(at)
        at, flat = at[rank], np.concatenate([x for _, x in done])[rank]
        ends = np.searchsorted(at, first_char + lengths)
        unknown = np.flatnonzero(flat < 0)
        if len(unknown):
            spelled = [[self.byte[b] for b in chr(chars[at[i]]).encode("utf-8", "surrogatepass")] for i in unknown]
            extra = np.ones(len(flat), dtype=np.int64)
            extra[unknown] = [len(x) for x in spelled]
            shift = np.append(0, np.cumsum(extra))
            flat = np.repeat(flat, extra)
            flat[flat < 0] = [b for x in spelled for b in x]
            ends = shift[ends]
        return flat.astype(np.int32, copy=False), ends

    def segment_many(self, words: list[str], key: int) -> list[bytes]:
        """The packed ids of many non-empty words that are segmented together, all with one dropout key."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat, ends = self._advance(chars, lengths, np.full(len(words), key, dtype=np.uint64))
        return [x.tobytes() for x in np.split(flat, ends[:-1])]

    def segment(self, word: str, key: int) -> list[int]:
        """The ids of one word (spaces, then other characters) with a dropout key, by an agenda of its own."""
        ids, rank, limit = self.ids, self.rank, self.limit
        symbols = list(word)
        size = len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        agenda = []

        def propose(left: int, right: int) -> None:
            merged = ids.get(symbols[left] + symbols[right])
            if merged is not None:
                agenda.append((rank[merged], left, right, len(symbols[left]) + len(symbols[right]), merged))

        for i in range(size - 1):
            propose(i, i + 1)
        heapq.heapify(agenda)
        while agenda:
            _, left, right, length, merged = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue
            if limit:
                mixed = ((key ^ (left * _PLACE & _MASK) ^ (merged * _PIECE & _MASK)) * _MIX_A) & _MASK
                mixed = ((mixed ^ (mixed >> 29)) * _MIX_B) & _MASK
                if mixed >> 32 < limit:
                    continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            follower = after[left] = after[right]
            if follower < size:
                before[follower] = left
            for pair in ((before[left], left), (left, follower)):
                if pair[0] >= 0 and pair[1] < size:
                    known = len(agenda)
                    propose(*pair)
                    if len(agenda) > known:
                        heapq.heappush(agenda, agenda.pop())
        out = []
        for symbol in symbols:
            if symbol:
                found = ids.get(symbol)
                if found is None:
                    out += [self.byte[b] for b in symbol.encode("utf-8", "surrogatepass")]
                else:
                    out.append(found)
        return out

    def encode(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray | None]:
        """The ids of whole texts; each key stands for the text's document."""
        known = [i for i, text in enumerate(texts) if text is not None]
        out: list[np.ndarray | None] = [None] * len(texts)
        if not known:
            return out
        chars = np.frombuffer("".join([" " + texts[i] for i in known]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(texts[i]) + 1 for i in known])
        first = np.cumsum(sizes) - sizes
        # a word is a run of spaces and the other characters after it
        begins = chars == 0x20
        begins[1:] &= chars[:-1] != 0x20
        begins[first] = True
        begins = np.flatnonzero(begins)
        lengths = np.diff(begins, append=len(chars))
        head = np.searchsorted(begins, first)
        words = np.diff(head, append=len(begins))
        own = mix64(np.array([(keys[i] + self.seed * _MIX_A) & _MASK for i in known], dtype=np.uint64))
        position = (np.arange(len(begins)) - np.repeat(head, words)).astype(np.uint64)
        drawn = mix64(np.repeat(own, words) + position * np.uint64(_PLACE))
        parts, counts, a = [], np.empty(len(begins), dtype=np.int64), 0
        while a < len(begins):
            b = max(a + 1, int(np.searchsorted(begins, begins[a] + _TOGETHER)))
            parts.append(self._segment_run(chars[begins[a] : begins[b - 1] + lengths[b - 1]], lengths[a:b], drawn[a:b], counts[a:b]))
            a = b
        flat, ends = np.concatenate(parts), np.cumsum(counts)
        last = ends[head + words - 1].tolist()
        for i, start, end in zip(known, [0, *last[:-1]], last, strict=True):
            out[i] = flat[start:end]
        return out

    def _segment_run(self, chars: np.ndarray, lengths: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of consecutive words, each with its own dropout key; sets how many each word has."""
        short = lengths <= _LONGEST
        if short.all():
            flat, ends = self._advance(chars, lengths, keys)
            counts[:] = np.diff(ends, prepend=0)
            return flat
        first, made = np.cumsum(lengths) - lengths, []
        for k in np.flatnonzero(~short):
            word = chars[first[k] : first[k] + lengths[k]].tobytes().decode("utf-32-le", "surrogatepass")
            made.append(np.array(self.segment(word, int(keys[k])), dtype=np.int32))
        counts[~short] = [len(x) for x in made]
        flat = np.empty(0, dtype=np.int32)
        if short.any():
            flat, ends = self._advance(chars[np.repeat(short, lengths)], lengths[short], keys[short])
            counts[short] = np.diff(ends, prepend=0)
        out, place = np.empty(int(counts.sum()), dtype=np.int32), np.repeat(short, counts)
        out[place], out[~place] = flat, np.concatenate(made)
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


_CODECS: dict[tuple, Codec] = {}


def codec(model: str = MODEL, dropout: float = 0.1, seed: int = 0) -> Codec:
    """The worker's codec for these settings; built once."""
    key = (model, dropout, seed)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds `tokens` (array<int>) to every row of `docs` (doc_id, text, ...).

    A null text has null tokens and an empty text one token, the space that the model puts first.  Rows with the same doc_id and
    text get the same tokens, and any others draws of their own; a null doc_id is a key like any other.  Extra columns
    of any name pass through; a column named like the added one is replaced.  An empty table gives an empty result.
    """

    def run(texts: pa.Array, keys: pa.Array) -> tuple[list]:
        return (codec(model, dropout, seed).encode(texts.to_pylist(), keys.to_pylist()),)

    docs, back = shield(docs, ["doc_id", "text"], ["tokens"])
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(seed), "doc_id", "text"))
    return extend(keyed, run, ["text", "__key"], "tokens array<int>", drop=["__key"]).select(*back, "tokens")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds `decoded`, the text that `tokens` stand for (null for null), to every row; a column of that name is replaced."""

    def run(tokens: pa.Array) -> tuple[list]:
        made = codec(model)
        ids, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
        rows = zip(tokens.is_valid().to_pylist(), ends[:-1], ends[1:], strict=True)
        return ([made.decode(ids[a:b].tolist()) if known else None for known, a, b in rows],)

    encoded, back = shield(encoded, ["tokens"], ["decoded"])
    return extend(encoded, run, ["tokens"], "decoded string").select(*back, "decoded")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    out = decode(encode(docs).drop("text"))
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select(
        "doc_id",
        F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>")).cast("binary"), 256).alias("tokens_sha256"),
        decoded.alias("decoded_sha256"),
        decoded.eqNullSafe(F.col("sha")).alias("lossless"),
    )
