"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, the metaspace marker, its
scores or merges, its byte fallback and its decoder are rebuilt as a tokenizers
pipeline that encodes and decodes Arrow batches on several threads.
:func:`summarize` compares its ids with the SentencePiece library's own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices, text_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            if key & 7 == 2:
                size, i = varint(i)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, i = data[i : i + size], i + size
        yield key >> 3, value


@dataclass
class PieceModel:
    """What a .model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def load(cls, path: str) -> PieceModel:
        model = cls()
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                model.pieces.append((part[1].decode(), unpack("<f", part[2])[0] if 2 in part else 0.0, part.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                model.kind, model.suffix, model.byte_fallback = spec.get(3, 1), bool(spec.get(24, 0)), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if model.kind not in (1, 2) or model.suffix or not model.escape:
            raise ValueError("only unigram and BPE models with a leading, escaped white-space marker are rebuilt")
        return model


def build(model: PieceModel):
    """A tokenizers.Tokenizer: a normaliser that escapes a text, a core that gives an escaped text, or one unit of it, the model's ids, and a decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == 1:
        core = models.Unigram([(p if t not in (CONTROL, UNUSED) else f"\0{i}", s) for i, (p, s, t) in enumerate(model.pieces)], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        usable = {p: s for p, s, t in model.pieces if t in (NORMAL, USER)}
        merges = []
        for piece, score in usable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    merges.append((-score, vocab[piece], vocab[left], vocab[right], left, right))
        merges.sort()
        core = models.BPE(vocab, [m[-2:] for m in merges], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(" ")] if model.dummy_prefix else []
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    parts = [decoders.ByteFallback()] if model.byte_fallback else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), *parts, decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


class Codec:
    """Encodes texts unit by unit: white-space markers and what follows them.

    No piece has the marker after another character, so no merge or segment
    crosses a unit's border and a unit's ids depend on it alone.  New units go
    to the tokenizers library in batches, on ``threads`` threads; known ones are
    looked up.  A model with such a piece is encoded a whole text at a time.

    With ``check`` new units are also encoded by the SentencePiece library and
    compared.  A model that squeezes white space but adds none at the start
    can't be compared by units, as it would strip theirs.
    """

    UNITS = 400_000
    #: Characters of a long text that are encoded at once, and of texts in one call of the library: its encodings take some hundred bytes a piece.
    CUT, CALL = 20_000, 250_000

    def __init__(self, path: str, threads: int = 2, check: bool = False):
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the library's pool of threads starts
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.model = PieceModel.load(path)
        self.backend = build(self.model)
        inner = any(MARK in p.lstrip(MARK) for p, _, t in self.model.pieces if t in (NORMAL, USER))
        self.unit = re.compile("(?s).+" if inner else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # a marker without a piece is unknown and may fuse with what stands before it
        self.border = None if inner or not any(p == MARK and t in (NORMAL, USER) for p, _, t in self.model.pieces) else re.compile(f"(?<!{MARK}){MARK}")
        self.known: dict[str, bytes] = {}
        self.silent = np.array([t == CONTROL for _, _, t in self.model.pieces])
        self.reference, self.differ, self.by_unit = None, set(), False
        if check:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_unit = self.model.dummy_prefix or not self.model.squeeze
        # the rebuilt normaliser costs more than a replacement, which is all that most texts of such a model need
        self.plain = not self.model.charsmap and not self.model.squeeze

    def escaped(self, text: str) -> str:
        if self.plain:
            return (" " + text if text and self.model.dummy_prefix else text).replace(" ", MARK)
        return self.backend.normalizer.normalize_str(text)

    def _parts(self, text: str) -> Iterator[str]:
        """An escaped text, or stretches of a long one that end where a unit does."""
        at = 0
        while at < len(text):
            cut = self.border.search(text, at + self.CUT) if self.border else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers.  Nothing is kept from one call to the next."""
        out = [bytearray() for _ in texts]
        part, owners, size = [], [], 0
        normalizer = self.backend.normalizer

        def flush() -> None:
            self.backend.normalizer = None  # the parts are escaped already
            try:
                for k, x in zip(owners, self.backend.encode_batch_fast(part, add_special_tokens=False)):
                    out[k] += np.array(x.ids, "<i4").tobytes()
            finally:
                self.backend.normalizer = normalizer
            part.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for stretch in self._parts(self.escaped(text)):
                if part and size + len(stretch) > self.CALL:
                    flush()
                    size = 0
                part.append(stretch)
                owners.append(k)
                size += len(stretch)
        flush()
        return [bytes(x) for x in out]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool | None]]:
        """Each text's ids as little-endian 32-bit integers, and whether all its units' ids were found equal to the reference library's; None where nothing was compared."""
        units = [self.unit.findall(self.escaped(t)) for t in texts]
        if len(self.known) > self.UNITS:
            self.known.clear()
            self.differ.clear()
        known = self.known
        self._learn(list(dict.fromkeys(u for us in units for u in us if u not in known)))
        get = known.__getitem__
        return [(b"".join(map(get, us)), (not self.differ or self.differ.isdisjoint(us)) if self.by_unit else None) for us in units]

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        normalizer, self.backend.normalizer = self.backend.normalizer, None  # units are escaped already
        try:
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                ids = [x.ids for x in self.backend.encode_batch_fast(part, add_special_tokens=False)]
                if self.by_unit:
                    cut = int(self.model.dummy_prefix)
                    self.differ.update(u for u, x, y in zip(part, ids, self.reference.encode([u[cut:].replace(MARK, " ") for u in part], num_threads=1)) if x != y and u != MARK)
                self.known.update((u, pack(f"<{len(x)}i", *x)) for u, x in zip(part, ids))
        finally:
            self.backend.normalizer = normalizer

    def whole(self, text: str, ids: bytes) -> bool:
        """Whether the SentencePiece library gives a whole text these ids."""
        return self.reference.encode(text) == np.frombuffer(ids, "<i4").tolist()

    def forget(self) -> None:
        """Drops the known units: a worker keeps the model for later tasks, but not what it learnt."""
        self.known, self.differ = {}, set()
        release()

    def decode(self, many: list[bytes]) -> list[str]:
        """The texts of lists of ids; control pieces have none."""
        ids = [np.frombuffer(x, "<i4") for x in many]
        return self.backend.decode_batch([x[~self.silent[x]].tolist() for x in ids], skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 2, check: bool = False) -> Codec:
    return Codec(path, threads, check)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _threads(docs: DataFrame, threads: int | None) -> int:
    """Two threads, or as many as a task has cores: work between the library's bursts is single-threaded."""
    return threads or max(2, int(docs.sparkSession.conf.get("spark.task.cpus", "1")))


def encode(docs: DataFrame, model_path: str | None = None, threads: int | None = None) -> DataFrame:
    """``docs`` with token_ids array<int> added; null text counts as empty, empty text has no ids.

    ``model_path`` must be readable on every executor.  Columns stay, but a
    column named token_ids is replaced.  Null ids and repeated rows stay; no
    rows give no rows.  ``threads`` is the tokenizers library's threads in each
    Python worker.
    """
    threads = _threads(docs, threads)
    path = model_path or default_model()
    docs = docs.drop("token_ids")
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, where):
                ids = codec(path, threads).ids([t or "" for t in batch.column(where).to_pylist()])
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "token_ids"])
        codec(path, threads).forget()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_path: str | None = None, threads: int | None = None) -> DataFrame:
    """``encoded`` with the text that its token_ids stand for as the column decoded; null ids decode to null.

    Other columns stay, but one named decoded is replaced; repeated rows repeat,
    no rows give no rows.
    """
    path, threads = model_path or default_model(), _threads(encoded, threads)
    encoded = encoded.drop("decoded")
    where = encoded.columns.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, max(1, len(whole)), 256)):
                ids = batch.column(where).to_pylist()
                texts = iter(codec(path, threads).decode([np.array(x, "<i4").tobytes() for x in ids if x is not None]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(texts) for x in ids], pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def summarize(docs: DataFrame, model_path: str | None = None, threads: int | None = None, whole_every: int = 50) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip, parity, whole_parity) of every row, in one pass.

    ids_sha256 is the hex SHA-256 of the ids as little-endian 32-bit integers;
    round_trip tells whether decoding gives the text back; parity whether the
    SentencePiece library gives the whole text the same ids, looked at in every
    row and for every model; whole_parity repeats it for ids divisible by
    ``whole_every`` and is null elsewhere.  Null text counts as empty, null ids
    and repeated rows stay, other columns are ignored.  No rows give no rows.
    """
    path, threads = model_path or default_model(), _threads(docs, threads)
    names, types = ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity", "whole_parity"], [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads, True)
        for whole in batches:
            for batch in slices(whole, 1):
                docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                got = own.ids(texts)
                back = own.decode(got)
                same = [own.whole(t, x) for t, x in zip(texts, got)]
                every = [y if d is not None and d % whole_every == 0 else None for d, y in zip(docs_, same)]
                cols = [docs_, [len(x) // 4 for x in got], [hashlib.sha256(x).hexdigest() for x in got], [b == t for b, t in zip(back, texts)], same, every]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        own.forget()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean, whole_parity boolean")
