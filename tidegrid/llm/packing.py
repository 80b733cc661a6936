"""Packing of documents into sequences under several limits at once.

A document's token ids end with id 0. It is cut where a sequence is full; what is left of
each document (a tail) is an item with three demands: tokens, one segment, tokens that bear
loss. Bins are filled one at a time by the dot-product heuristic: of the items that fit, the
one whose demands, weighted by the scarcity of each resource, have the largest dot product
with the bin's remaining room. A gap of ``min_cut`` tokens or more is then filled with the
head of the largest item, whose rest stays an item.

A task packs its own rows as they stream by, with at most ``window`` tails in hand, and
leaves at most a few sequences short. Nothing is shuffled, and a repeated task gives the
same sequences, as their ids are the partition's number and a counter.

Defined results: null text counts as empty: one id, the end. Repeated documents are packed
each for itself; ties go to the item that came first; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm.common import TEXT, field, slices

END_ID = 0
# Fixed value: the split of byte-level vocabularies before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters for
    themselves, the other bytes in turn from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(path: str) -> tiktoken.Encoding | None:
    """The same merges as ranks, which is faster; None if ids do not follow the order of merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    single = sorted(model["vocab"][c] for c in byte_alphabet() if c in model["vocab"])
    if (spec.get("normalizer") or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
            or made != list(range(256, 256 + len(made))) or single != list(range(256)) or model.get("unk_token")):
        return None
    alphabet = byte_alphabet()
    ranks = {bytes(map(alphabet.__getitem__, piece)): i for piece, i in model["vocab"].items() if i < 256 + len(made)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers, the end id last."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.ranks = Tokenizer.from_file(path), ranked(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([END_ID], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if any(s in text for s in self.special):
            return self._by_tokenizer(text, False) + self.end
        return self.plain(text) + self.end

    def plain(self, text: str) -> bytes:
        """Ids without an end id; strings of special tokens are plain text."""
        if self.ranks is not None:
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its split backtracks too far over very long white space
                pass
        return self._by_tokenizer(text, True)

    def _by_tokenizer(self, text: str, plain: bool) -> bytes:
        self.tokenizer.encode_special_tokens = plain
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Packer:
    """Open items of one task. ``limits``: tokens, segments, loss-bearing tokens of a sequence."""

    def __init__(self, limits: tuple[int, int, int], window: int, min_cut: int, first_id: int):
        self.limits = np.array(limits, float)
        self.tokens, self.segments, self.loss = limits
        self.window, self.min_cut, self.next_id = window, min_cut, first_id
        self.items: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes, loss_from: int) -> None:
        """Cut what cannot share a sequence; keep the rest as an item. ``loss_from``: ids before it bear no loss."""
        total, at = len(ids) // 4, 0
        while total - at >= self.tokens or self._loss(at, total - at, loss_from) > self.loss:
            size = min(self.tokens, total - at)
            size = min(size, max(0, loss_from - at) + self.loss)
            if size == self.tokens:
                self._place([(doc, at, size, ids, total, loss_from)])
            else:
                self.items.append((doc, at, size, ids, total, loss_from))
            at += size
        if at < total:
            self.items.append((doc, at, total - at, ids, total, loss_from))
        if len(self.items) >= self.window:
            self.pack(self.window // 2)

    @staticmethod
    def _loss(at: int, size: int, loss_from: int) -> int:
        return max(0, at + size - max(at, loss_from))

    def _place(self, pieces) -> None:
        offset = 0
        for doc, at, size, ids, total, loss_from in pieces:
            self.out.append((doc, at, size, ids[4 * at:4 * (at + size)], total, self.next_id, offset,
                             self._loss(at, size, loss_from)))
            offset += size
        self.next_id += 1

    def pack(self, left: int) -> None:
        """Close bins until at most ``left`` items are open."""
        while len(self.items) > left:
            items = self.items
            needs = np.array([(x[2], 1, self._loss(x[1], x[2], x[5])) for x in items], float) / self.limits
            # Scarce resources weigh more.
            weighted = needs * needs.sum(axis=0)
            open_, rest = np.ones(len(items), bool), []
            while open_.any() and int(open_.sum()) + len(rest) > left:
                room, chosen = np.ones(3), []
                while True:
                    fits = open_ & (needs <= room + 1e-9).all(axis=1)
                    if not fits.any():
                        break
                    k = int(np.where(fits, weighted @ room, -1.0).argmax())
                    chosen.append(k)
                    open_[k] = False
                    room -= needs[k]
                pieces = [items[k] for k in chosen]
                gap = self.tokens - sum(p[2] for p in pieces)
                if gap >= self.min_cut and len(pieces) < self.segments and open_.any():
                    k = int(np.where(open_, needs[:, 0], -1.0).argmax())
                    doc, at, size, ids, total, loss_from = items[k]
                    used = sum(self._loss(p[1], p[2], p[5]) for p in pieces)
                    head = min(gap, size - 1, max(0, loss_from - at) + self.loss - used)
                    if head > 0:
                        open_[k] = False
                        pieces.append((doc, at, head, ids, total, loss_from))
                        rest.append((doc, at + head, size - head, ids, total, loss_from))
                self._place(pieces)
            self.items = rest + [x for x, o in zip(items, open_) if o]


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", loss_from: str | None = None,
         limits: tuple[int, int, int] = (1024, 128, 1024), window: int = 1024, min_cut: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset, loss_tokens. ``loss_from`` names a column: ids before that place bear no loss."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(TEXT),
                     (F.coalesce(F.col(loss_from), F.lit(0)) if loss_from else F.lit(0)).cast("long").alias("loss_from"))
    schema = rows.select("doc_id").schema
    for name, kind in (("start", "long"), ("length", "long"), ("tokens", "binary"), ("doc_tokens", "long"),
                       ("sequence_id", "long"), ("offset", "long"), ("loss_tokens", "long")):
        schema = schema.add(field(name, kind))

    def run(batches):
        known = Ids(path)
        packer = Packer(limits, window, min_cut, TaskContext.get().partitionId() << 32)
        kind = None

        def drain():
            out, packer.out = packer.out, []
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.binary() if i == 2 else pa.int64())
                                               for i, c in enumerate(columns[1:]))], names=schema.names)

        for part in slices(batches, TEXT):
            kind = part.column("doc_id").type
            ids = map(known.encode, part.column(TEXT).to_pylist())
            for doc, code, begin in zip(part.column("doc_id").to_pylist(), ids, part.column("loss_from").to_pylist()):
                packer.add(doc, code, begin)
            if packer.out:
                yield drain()
        packer.pack(0)
        if packer.out:
            yield drain()

    return rows.mapInArrow(run, schema)


def pieces(df: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of documents."""
    return pack(df, path).select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"),
                                 "doc_tokens", "sequence_id", "offset")
