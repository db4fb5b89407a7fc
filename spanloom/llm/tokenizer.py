"""Byte-level BPE as a lazily determinised transducer, over whole texts.

The vocabulary's ranks are compiled into a trie of token bytes. A transducer reads a piece of text
byte by byte. Its state stands for all that later tokens can depend on: the bytes read last, as far
as they begin some token, and for each of these bytes the token that would end the encoding there.
The token that ends the encoding after a further byte is the longest suffix that forms a valid pair
with the token ending before it, where (a, b) is valid if merging the bytes of a and b afresh gives
just a and b: for merges by rank exactly one suffix does, and it ends the encoding of these bytes in
any text that continues them. States and transitions are made when first needed and kept.

A token is final once every token that can still end the encoding follows from it; the lookahead
this takes is bounded by the longest token. Pieces are cut by the vocabulary's pattern before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The public tokenizer's vocabulary, by its name in the package public_tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a task remembers, states that its transducer keeps and pairs known to be valid or
#: not; beyond, they are made anew.
PIECES, STATES, VALID = 1 << 18, 1 << 17, 1 << 19
#: Pieces of more characters aren't remembered; tokens of more bytes ahead are settled before going on.
LONG, LOOKAHEAD = 64, 2048


class Vocabulary:
    """Ranks by token bytes, merging by rank, and the pairs that such merging leaves apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.valid: dict[int, bool] = {}
        # tokens reversed, in a trie of dicts: all tokens that end at a place are found walking back
        self.back: dict = {}
        for token, rank in ranks.items():
            node = self.back
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.begin: set[bytes] = {token[:k] for token in ranks for k in range(1, len(token) + 1)}

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes from first principles: the pair of least rank is merged, again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def pair_is_valid(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) >= VALID:
                self.valid.clear()
            known = self.valid[key] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known


class Transducer:
    """Lazily determinised: state (suffix bytes, tokens ending there) -> (next state, token) by byte."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.at: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self._state(b"", (-1,))

    def _state(self, suffix: bytes, ends: tuple) -> int:
        key = (suffix, ends)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = len(self.at)
            self.at.append(key)
            self.moves.append({})
        return state

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """ends[k] is the token that ends the encoding len(suffix) - k bytes ago, -1 at the piece's start."""
        suffix, ends = self.at[state]
        data = suffix + bytes((byte,))
        node, found, k = self.v.back, -1, len(data)
        longest = []
        while k > 0 and (node := node.get(data[k - 1])) is not None:
            k -= 1
            if -1 in node:
                longest.append((k, node[-1]))
        for k, token in reversed(longest):
            before = ends[k]
            if before == -1 and self.v.merged(data[k:]) == [token] or before >= 0 and self.v.pair_is_valid(before, token):
                found = token
                break
        ends += (found,)
        # what no token can begin any more is forgotten: the longest suffix that begins a token stays
        cut = 0
        while data[cut:] and data[cut:] not in self.v.begin:
            cut += 1
        return self._state(data[cut:], ends[cut:]), found

    def encode(self, data: bytes) -> list[int]:
        """Ids of a piece. Of a long one, tokens are put out while it is read, as soon as they are final."""
        if len(self.at) > STATES:
            self.clear()
        state, last, out = self.start, [], []
        moves = self.moves
        for byte in data:
            step = moves[state].get(byte)
            if step is None:
                step = moves[state][byte] = self._move(state, byte)
            state = step[0]
            last.append(step[1])
            if len(last) >= LOOKAHEAD:
                settled = self._settled(last, len(self.at[state][0]))
                out += self._back(last, settled)
                del last[:settled]
        return out + self._back(last, len(last))

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens that lead to a place."""
        ids, tokens = [], self.v.tokens
        while at:
            ids.append(last[at - 1])
            at -= len(tokens[last[at - 1]])
        return ids[::-1]

    def _settled(self, last: list[int], window: int) -> int:
        """The furthest place through which every encoding of a continuation passes.

        A further token begins at one of the last `window` places; where the ways back from all of
        these meet, what lies before is final.
        """
        sizes, common = self.v.tokens, None
        for at in range(max(0, len(last) - window), len(last) + 1):
            way = {at}
            while at:
                at -= len(sizes[last[at - 1]])
                way.add(at)
            common = way if common is None else common & way
        return max(common)


class Encoder(dict):
    """Ids of texts; as a dict, ids by piece, for the pieces met last."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        super().__init__()
        self.pieces = regex.compile(vocabulary.pattern).findall
        self.transducer = Transducer(vocabulary)

    def __missing__(self, piece: str) -> list[int]:
        ids = self.transducer.encode(piece.encode())
        if len(piece) <= LONG:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text)))) if text else 0


class Utf8Decoder:
    """Decodes bytes that come in parts of any size; bytes that are no UTF-8 become U+FFFD.

    The state is the bytes still due of a character and those held of it.
    """

    def __init__(self):
        self.held, self.due = b"", 0

    def feed(self, data: bytes) -> str:
        out, start = [], 0
        due, held = self.due, self.held
        for at, byte in enumerate(data):
            if due and 0x80 <= byte < 0xC0:
                due -= 1
                continue
            # a character begins here
            due = 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3 if byte < 0xF8 else 0
            if due:
                out.append((held + data[start:at]).decode(errors="replace"))
                held, start = b"", at
        if due:
            self.held, self.due = held + data[start:], due
        else:
            out.append((held + data[start:]).decode(errors="replace"))
            self.held, self.due = b"", 0
        return "".join(out)

    def end(self) -> str:
        rest, self.held, self.due = self.held, b"", 0
        return rest.decode(errors="replace")


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker and vocabulary; reused workers keep what it has learnt."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(Vocabulary.load(path, pattern))
    return _loaded[path, pattern]


def public(name: str = VOCABULARY) -> tuple[str, str]:
    """(path, pattern) of a vocabulary of ranks installed with public_tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def token_ids(documents: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text): an ids list for each row, empty for null and empty texts.

    No special tokens are added, and their strings in a text are ordinary text. Rows map one to one,
    in their partitions, without a shuffle; doc_id may be null or repeated.
    """
    path, pattern = vocabulary or public()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(path, pattern).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [encode(text) for text in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens) of documents (doc_id, text): the lengths of token_ids' lists."""
    path, pattern = vocabulary or public()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path, pattern).count
        for batch in batches:
            n = pa.array([count(text) for text in batch.column(1).to_pylist()], pa.int64())
            yield pa.record_batch([batch.column(0), n], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def decoded(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null and empty lists give the empty text."""
    path, pattern = vocabulary or public()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, pattern).transducer.v.tokens
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = Utf8Decoder()
                parts = [decoder.feed(b"".join(map(tokens.__getitem__, ids[at : at + 4096]))) for at in range(0, len(ids or []), 4096)]
                texts.append("".join(parts) + decoder.end())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read(spark, sf_dir, "documents"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many documents have ids, and for how many decoding them doesn't give the text again."""
    documents = read(spark, sf_dir, "documents")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    both = decoded(token_ids(documents)).join(texts, "doc_id")
    return both.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("text") != F.col("original"), 1)).alias("differing"))


P7_ROUNDTRIP_SQL = """
select count(*) as documents, 0 as differing from documents
"""
