"""Token counts and token ids of whole texts through caches of white-space separated pieces.

The vocabulary's own library encodes a piece once per worker; a text is the concatenation of its pieces.
That is exact for tokenizers that drop white space and never merge across it, such as ``word_bpe_49k.json``:
blank and line feed end a pre-token there, and neither normalisation nor special strings reach across them.
For others pass ``by_piece=False``; whole texts are then encoded without a cache.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import columns_of, put, worker_cache

VOCAB = "word_bpe_49k.json"
CACHE = 300_000     # pieces a worker keeps, and as many of their parts
MARKS = ".,;:!?%$*#&|()-"  # closing marks that are neither letters, digits, apostrophes nor part of a special string
LONGEST = 200       # bytes of the longest piece that is kept
FREQUENT = 20_000   # pieces of the broadcast table


def vocab_path(name: str) -> str:
    """The place of a vocabulary: a path as it is, or a file of the installed package of public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes text without added special tokens, with the defaults of the vocabulary's library.

    ``run`` is for runs of lower-case ASCII letters: where the vocabulary's normaliser and splitter leave those as they
    are, the library's model is asked for their ids alone; elsewhere it is ``ids``.
    """

    def __init__(self, vocab: str):
        path = vocab_path(vocab)
        if path.endswith(".json"):
            from tokenizers import Tokenizer
            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
            self.ids = self.run = lambda text: made.encode(text, add_special_tokens=False).ids
            if self._plain(made):
                tokenize = made.model.tokenize
                self.run = lambda text: [t.id for t in tokenize(text)]
        else:
            import sentencepiece
            made = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = self.run = lambda text: made.encode(text)

    @staticmethod
    def _plain(made) -> bool:
        """Whether a run of lower-case ASCII letters reaches the model whole and unchanged, and no added token is one."""
        probes = ["abcdefghijklmnopqrstuvwxyz", *"abcdefghijklmnopqrstuvwxyz", "ssttrreevvmmlldd"]
        same = made.normalizer is None or all(made.normalizer.normalize_str(p) == p for p in probes)
        whole = made.pre_tokenizer is None or all([s for s, _ in made.pre_tokenizer.pre_tokenize_str(p)] == [p] for p in probes)
        letters = any(t.content.isascii() and t.content.isalpha() for t in made.get_added_tokens_decoder().values())
        return same and whole and not letters and all(made.encode(p, add_special_tokens=False).ids == [t.id for t in made.model.tokenize(p)] for p in probes)

    @classmethod
    def of(cls, vocab: str) -> "Encoder":
        """The encoder of this process; it goes with the caches when another operator takes the worker."""
        made = common.worker_cache("tokens")
        if vocab not in made:
            made[vocab] = cls(vocab)
        return made[vocab]


def pieces(text: bytes) -> list[bytes]:
    return text.replace(b"\n", b" ").split(b" ")


class _Letters(dict):
    """Values of runs of letters and of runs of marks, encoded on a miss."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, run: str):
        got = self.value(run)
        if len(run) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[run] = got
        return got


class PieceCache(dict):
    """Values of pieces. A missing piece of letters and closing marks is put together from the two, others are encoded.

    The vocabulary splits letters from marks, so the parts of such a piece are encoded apart by the library too.
    """

    def __init__(self, value, known=()):
        super().__init__(known)
        self[b""] = self.empty = value("")
        self.value, self.parts = value, _Letters(value)

    def __missing__(self, piece: bytes):
        text = piece.decode("utf-8", "replace")
        head = text.rstrip(MARKS)
        low = head.lower()
        if low.isalpha() and head.isalpha():
            got = self.parts[low if head.isascii() else head]
            if len(head) < len(text):
                got = got + self.parts[text[len(head):]]
        else:
            got = self.value(text)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
                self[b""] = self.empty
            self[piece] = got
        return got


def cache_of(vocab: str, kind: str) -> PieceCache:
    """Lengths of pieces (``count``) or their ids as little-endian unsigned 32-bit numbers (``ids``)."""
    caches = worker_cache("tokens")  # kept from task to task
    if (vocab, kind) not in caches:
        encode = Encoder.of(vocab).ids
        run = Encoder.of(vocab).run

        def value(text: str):
            ids = run(text) if text.isascii() and text.isalpha() and text.islower() else encode(text)
            return len(ids) if kind == "count" else struct.pack(f"<{len(ids)}I", *ids)
        caches[vocab, kind] = PieceCache(value)
    return caches[vocab, kind]


def _raw(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def frequent_pieces(texts: DataFrame, most: int = FREQUENT) -> list[bytes]:
    """The pieces with the greatest counts over all texts; counts below a task's own top are not seen.

    A task sends at most ``most`` rows, so what is added up does not grow with the texts, only with the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in _raw(batch.column(0)):
                held.update(pieces(text))
            if len(held) > 20 * most:
                held = Counter(dict(held.most_common(4 * most)))
        held.pop(b"", None)
        top = [(k, n) for k, n in held.most_common(most) if len(k) <= LONGEST and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    summed = texts.mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [bytes(r.piece) for r in summed.orderBy(F.desc("n"), "piece").limit(most).collect()]


def token_counts(docs: DataFrame, vocab: str = VOCAB, limit: int = 2048, by_piece: bool = True, frequent: int = FREQUENT, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Two tiers: a broadcast table has the lengths of the ``frequent`` commonest pieces of all texts; a miss is encoded
    once and stays in the worker's cache. Nothing is shuffled but each task's bounded list of its commonest pieces,
    and that list only decides what is fast, never a count.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows and null ids are counted row by row. Input columns with the
    names of the new ones give way. An empty table gives an empty table.
    """
    texts = columns_of(docs, text_col)
    known: dict[bytes, int] = {}
    if by_piece:
        encode = Encoder.of(vocab).ids
        known = {p: len(encode(p.decode("utf-8", "replace"))) for p in frequent_pieces(texts, frequent)}
    known[b""] = 0
    tier = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = Encoder.of(vocab).ids
        first = tier.value
        misses = cache_of(vocab, "count") if by_piece else None

        class _Tiers(dict):
            def __missing__(self, piece):
                return misses[piece]
        lengths = _Tiers(first).__getitem__
        for texts in parts:
            if by_piece:
                yield pd.Series([sum(map(lengths, pieces(x.encode()))) if x else 0 for x in texts], dtype="int64")
            else:
                yield pd.Series([len(encode(x)) if x else 0 for x in texts], dtype="int64")

    text = F.col(f"`{next(c for c in docs.columns if c.lower() == text_col.lower())}`")
    out = put(docs, n_bytes=F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), n_tokens=counted(text))
    return put(out, over_limit=F.col("n_tokens") > limit)


def id_bytes(vocab: str = VOCAB, by_piece: bool = True):
    """A function from text to its ids as little-endian unsigned 32-bit numbers."""
    if not by_piece:
        encode = Encoder.of(vocab).ids
        return lambda text: np.asarray(encode(text), "<u4").tobytes()
    ids = cache_of(vocab, "ids").__getitem__
    return lambda text: b"".join(map(ids, pieces(text.encode())))
