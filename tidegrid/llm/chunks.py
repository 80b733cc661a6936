"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers and the characters up to the next marker. No piece
of the model crosses the start of a chunk (``check_model`` proves it), so each distinct
chunk is segmented once a task's table and its ids are joined back by position. Decoding joins the
bytes of the pieces. The chunk table belongs to a task and starts afresh at ``bound``
characters, so memory stays bounded; chunks too long to come again are not kept at all.

Defined results: null text counts as empty; empty text gives the end id alone and decodes
to the empty text. Repeated rows and ties need no care: rows are independent.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import field, lists, map_texts

MARKER = "▁"
LONG, ENTRY = 256, 16  # Longest chunk that is kept; characters that an entry counts besides its own.
CHUNK = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Refuse a model for which chunks are not independent."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        spec.ParseFromString(f.read())
    n = spec.normalizer_spec
    if (n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces
            or spec.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError("the model rewrites texts; chunks cannot be cut before it")
    if any(p.type == p.USER_DEFINED or MARKER in p.piece.lstrip(MARKER) for p in spec.pieces):
        raise ValueError("a piece crosses the start of a word")


class ChunkTable:
    """Distinct chunks, without their first marker, and the ids of each as little-endian int32 bytes."""

    def __init__(self, model: str, bound: int = 8_000_000):
        self.processor, self.bound, self.size = load(model), bound, 0
        self.marker = np.array([self.processor.piece_to_id(MARKER)], np.int32).tobytes()
        self.end = np.array([self.processor.eos_id()], np.int32).tobytes()
        self.starts = np.array([self.processor.id_to_piece(i).startswith(MARKER)
                                for i in range(self.processor.get_piece_size())], bool)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str | None) -> list[str]:
        """The chunks of a text. The processor puts their first marker itself, so they come without."""
        if not text:
            return []
        if "  " in text or MARKER in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in CHUNK.findall(MARKER + text.replace(" ", MARKER))]
        return text.split(" ")

    def segment(self, chunks: list[str]) -> None:
        """Segment chunks into the table. Those without further markers go joined by spaces: each begins
        with the one piece that starts with a marker, which is where the ids are cut."""
        plain = [c for c in chunks if c and MARKER not in c]
        for i in range(0, len(plain), 4096):
            some = plain[i:i + 4096]
            ids = np.array(self.processor.encode(" ".join(some), num_threads=1), np.int32)
            edges = [*(np.flatnonzero(self.starts[ids]) * 4).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip(edges, edges[1:])], strict=True))
        other = [c for c in chunks if MARKER in c]
        for c, ids in zip(other, self.processor.encode(other, num_threads=1)):
            self.known[c] = np.array(ids, np.int32).tobytes()
        if "" in chunks:
            self.known[""] = self.marker

    def encode(self, texts: list[str | None]) -> list[bytes]:
        docs = [self.cut(t) for t in texts]
        known = self.known
        new = set().union(*docs).difference(known)
        added = sum(map(len, new)) + ENTRY * len(new)
        if self.size + added > self.bound:
            known.clear()
            new = set().union(*docs)
            self.size, added = 0, sum(map(len, new)) + ENTRY * len(new)
        self.segment(list(new))
        self.size += added
        out = [b"".join([*map(known.__getitem__, doc), self.end]) for doc in docs]
        for long in [c for c in new if len(c) > LONG]:
            del known[long]
            self.size -= len(long) + ENTRY
        return out


class PieceTable:
    """The bytes each id stands for. A text is the join of its pieces' bytes."""

    def __init__(self, model: str):
        self.processor = p = load(model)
        self.pieces = []
        for i in range(p.get_piece_size()):
            if p.is_byte(i):
                self.pieces.append(bytes([int(p.id_to_piece(i)[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                self.pieces.append(p.decode([i]).encode())
            else:
                self.pieces.append(p.id_to_piece(i).replace(MARKER, " ").encode())
        self.plain = [not (p.is_control(i) or p.is_unknown(i)) for i in range(p.get_piece_size())]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids. Odd ones (a control id first, bytes that are no UTF-8) go to the processor."""
        ids = ids.tolist()
        if not ids or not self.plain[ids[0]]:
            return self.processor.decode(ids)
        try:
            text = b"".join(map(self.pieces.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.processor.decode(ids)
        return text[1:] if self.pieces[ids[0]].startswith(b" ") else text


def encode(df: DataFrame, model: str, keep, text: str = "text") -> DataFrame:
    """``keep`` plus ``ids`` (array of int, the end id last) of every whole text."""
    check_model(model)

    def start():
        known = ChunkTable(model)

        def work(texts):
            docs = known.encode(texts)
            return [lists(b"".join(docs), [len(d) // 4 for d in docs])]
        return work

    return map_texts(df, keep, text, [field("ids", "array<int>")], start)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of its ids (null ids: null). ``out`` replaces a column of its name."""
    check_model(model)
    keep = [c for c in df.columns if c != out]
    schema = df.select(*(F.col(f"`{c}`") for c in keep)).schema.add(field(out, "string"))

    def run(batches):
        known = PieceTable(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                column = part.column(ids)
                texts = [None if x is None else known.decode(np.array(x.values.to_numpy(zero_copy_only=False), np.int32))
                         for x in (v if v.is_valid else None for v in column)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())],
                                                 names=[*keep, out])

    return df.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def digests(df: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents, from the ids and texts the operator gives."""
    out = decode(encode(df, model, ["doc_id"]), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
