"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its pieces, scores, types and normaliser are read field by
field and rebuilt as a tokenizer: unigram models from their scores, BPE models from the
merges that their scores order, both with byte fallback. Spaces become the metaspace
marker. No piece holds the marker after another character, nor a newline with anything
else, so a text's ids are those of its segments in a row; segments are encoded in
multithreaded batches, kept in a bounded cache, and each is checked once against the
original library and once by decoding.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetspark.llm.base import chunks, per_worker

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_BYTES = 160 << 20
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    """Pieces and settings of a model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.unigram = trainer.get(3, 1) == 1
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def tokenizer(self):
        """A tokenizer of normalised text."""
        from tokenizers import AddedToken, Tokenizer, models

        if self.unigram:
            low = min(s for _, s, kind in self.pieces if kind == NORMAL) - 10
            vocabulary = [(p, low if kind in (UNKNOWN, CONTROL) else s) for p, s, kind in self.pieces]
            made = Tokenizer(models.Unigram(vocabulary, self.unknown, self.byte_fallback))
        else:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            merges = []
            for piece, score, kind in self.pieces:
                if kind in (NORMAL, USER_DEFINED, UNUSED):
                    for cut in range(1, len(piece)):
                        if piece[:cut] in ids and piece[cut:] in ids:
                            merges.append((-score, ids[piece], ids[piece[:cut]], piece[:cut], piece[cut:]))
            made = Tokenizer(
                models.BPE(ids, [m[3:] for m in sorted(merges)], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
            )
        made.add_tokens([AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER_DEFINED])
        return made

    def normalised(self, text: str) -> str:
        if self.charsmap:
            from tokenizers.normalizers import Precompiled

            text = Precompiled(self.charsmap).normalize_str(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK)

    @property
    def segmented(self) -> bool:
        """Whether ids of segments in a row are ids of the text."""
        return all(MARK not in p.lstrip(MARK) and ("\n" not in p or p == "\n") for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED))


class Coder:
    """Encodes and decodes with the rebuilt tokenizer; checks segments against the original."""

    def __init__(self, path: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as file:
            self.model = Model(file.read())
        self.tokenizer = self.model.tokenizer()
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(p, kind) for p, _, kind in self.model.pieces]
        self.known: dict[str, tuple[bytes, bool, bool]] = {}
        self.held = 0
        self.split = _SEGMENT.findall if self.model.segmented else lambda text: [text] if text else []

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def _original(self, segments: list[str]) -> list[list[int]]:
        """Ids by the original library; one that does not start as a text does is put after a newline."""
        if not self.model.segmented or not self.model.dummy_prefix:
            return [self.original.encode(s.replace(MARK, " ")[self.model.dummy_prefix :]) for s in segments]
        lead = len(self.original.encode("\n"))
        alone = [s[0] == MARK and len(s) > 1 for s in segments]
        texts = [s.replace(MARK, " ")[1:] if whole else "\n" + s.replace(MARK, " ") for s, whole in zip(segments, alone)]
        return [ids if whole else ids[lead:] for whole, ids in zip(alone, self.original.encode(texts, num_threads=2))]

    def learn(self, seen: set[str]) -> None:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        new = sorted(seen.difference(self.known))
        for a in range(0, len(new), 4_000):
            some = new[a : a + 4_000]
            rebuilt = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            for segment, got, true in zip(some, rebuilt, self._original(some)):
                ids = got.ids
                back = b"".join([self.bytes_of[i] for i in ids]) == segment.replace(MARK, " ").encode()
                raw = np.array(ids, "<u4").tobytes()
                self.known[segment] = raw, ids == true, back
                self.held += 240 + len(segment) + len(raw)  # with the objects' own size

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bool, bool]]:
        """For each text its ids as bytes, whether they equal the original's, whether they decode to it."""
        split = [self.split(self.model.normalised(t)) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        for segments in split:
            got = list(map(get, segments))
            yield b"".join([g[0] for g in got]), all([g[1] for g in got]), all([g[2] for g in got])


def encoded(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_ids, ids_crc32, parity, round_trip (and ids).

    ids_crc32 is over little-endian unsigned 32-bit ids; parity says that the ids equal
    those of the original library, round_trip that they decode to the normalised text.
    NULL and empty texts have no ids. Rows may repeat; an empty table gives none. Columns
    other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(("spiece", model_path), lambda: Coder(model_path))
        for batch in batches:
            for first, texts in chunks(batch, most=250_000):
                raw, same, back = zip(*coder.encode(texts))
                columns = [pa.array([len(r) // 4 for r in raw]), pa.array([zlib.crc32(r) for r in raw]), pa.array(same), pa.array(back)]
                names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *columns], names=names)

    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); NULL ids give the empty text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(("spiece", model_path), lambda: Coder(model_path))
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
