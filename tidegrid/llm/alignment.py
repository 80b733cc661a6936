"""Alignment of two tokenizers' tokens by byte offsets, as an Arrow pipeline.

A text is encoded by a byte-level vocabulary (A, over a space and the text) and by a piece
model (B, which adds that space itself). Per slice of texts the id lists are flattened with
their parent indices, segmented cumulative sums of token bytes give the place where each token
ends, and an Acero hash join of both sides on (document, end) finds the common ends. They cut
the tokens into groups and link the two tokens that end there.

Counts of linked id pairs over the corpus are ``Table.group_by`` counts of each slice, merged by
Spark. Of two tokens that end together one is a suffix of the other, so the vocabularies alone
bound the pairs (``Sides.pairs``; 324,302 for the given files): the counts of all pairs
may be sent to every task whatever the size of the corpus.

Defined results: null or empty texts, and texts whose joined token bytes on either side differ
from space + text (such as those with U+2581), have no tokens and no groups. Special tokens'
strings inside texts are plain text. Repeated rows are aligned each for itself and all counted; a null id is
carried along; equal counts are all highest; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.chunks import MARKER, ChunkTable, check_model, load
from tidegrid.llm.common import field, lists, map_texts, written
from tidegrid.llm.packing import Ids, byte_alphabet

DOCUMENT_BITS = 40  # A key holds the document's place in its slice above the byte offset.
LISTS = ("a_ids", "b_ids", "a_sizes", "b_sizes")


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; added tokens stand for their strings."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
    added = {t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() if i in added else bytes(map(alphabet.__getitem__, token))
    return out


def piece_bytes(model: str) -> list[bytes]:
    """The bytes of each piece."""
    p = load(model)
    return [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(MARKER, " ").encode()
            for i in range(p.get_piece_size())]


class Sides:
    """Token bytes of both vocabularies and the pairs of ids that can end together."""

    def __init__(self, a: Sequence[bytes], b: Sequence[bytes]):
        self.bytes = [pa.array(side, pa.binary()) for side in (a, b)]
        self.lengths = [pc.binary_length(side).cast(pa.int64()) for side in self.bytes]
        self.n_b = len(b)
        # Decimal ids with the sign that follows them, inside and at the end of a group.
        self.names = pa.array([f"{i}{sign}" for ids, signs in ((len(a), ",|"), (len(b), ",;")) for sign in signs
                               for i in range(ids)], pa.string())
        known_a, known_b = ({}, {})
        for known, side in ((known_a, a), (known_b, b)):
            for i, x in enumerate(side):
                known.setdefault(x, []).append(i)
        codes = set()
        for x, ids in known_a.items():
            for start in range(len(x)):
                codes.update(i * self.n_b + j for j in known_b.get(x[start:], ()) for i in ids)
        for x, ids in known_b.items():
            for start in range(1, len(x)):
                codes.update(i * self.n_b + j for i in known_a.get(x[start:], ()) for j in ids)
        self.pairs = np.array(sorted(codes), np.int64)


@functools.lru_cache(maxsize=2)
def sides(a: str, b: str) -> Sides:
    return Sides(token_bytes(a), piece_bytes(b))


def ends(ids: pa.Array, offsets: np.ndarray, lengths: pa.Array) -> np.ndarray:
    """Key (document, byte end) of each token of a list column: segmented cumulative sums."""
    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)
    parents = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    total = pc.cumulative_sum(lengths.take(ids)).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], total])[offsets[:-1]]
    return (parents.astype(np.int64) << DOCUMENT_BITS) + total - before[parents]


def spelled(ids: pa.Array, offsets: np.ndarray, table: pa.Array, texts: Sequence[bytes]) -> list[bool]:
    """Whether each list of ids spells its text."""
    column = table.take(ids).cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64)[:len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = memoryview(column.buffers()[2] or b"").cast("B")
    starts = places[offsets].tolist()
    return [data[a:b] == t for a, b, t in zip(starts, starts[1:], texts)]


class Aligner:
    """Aligns slices of texts. The two encoders start once a task."""

    def __init__(self, a: str, b: str):
        self.sides, self.bytes, self.pieces = sides(a, b), Ids(a), ChunkTable(b)

    def encoded(self, texts: Sequence[str]) -> list[list[bytes]]:
        """Little-endian 32-bit ids of both sides, without an end id."""
        return [[self.bytes.plain(" " + t) for t in texts], [x[:-4] for x in self.pieces.encode(texts)]]

    def __call__(self, texts: Sequence[str | None]) -> list[pa.ListArray]:
        """The LISTS: ids of both sides, and how many of each side's tokens lie in each group."""
        coded = self.encoded([t or "" for t in texts])
        whole = [(" " + t).encode() if t else b"" for t in texts]
        fine = np.array([bool(t) for t in texts], bool)
        for side in (0, 1):
            ids, offsets = _flat(coded[side])
            fine &= np.array(spelled(ids, offsets, self.sides.bytes[side], whole), bool)
        (a, a_offsets), (b, b_offsets) = (_flat([x if f else b"" for x, f in zip(side, fine)]) for side in coded)
        common = self.joined(a, a_offsets, b, b_offsets)
        documents = common["key"].to_numpy() >> DOCUMENT_BITS
        counts = np.bincount(documents, minlength=len(texts))
        sizes = [np.diff(common[side].to_numpy(), prepend=-1).astype(np.int32) for side in ("at_a", "at_b")]
        return [pa.ListArray.from_arrays(pa.array(a_offsets, pa.int32()), a), pa.ListArray.from_arrays(pa.array(b_offsets, pa.int32()), b),
                lists(sizes[0], counts), lists(sizes[1], counts)]

    def joined(self, a, a_offsets, b, b_offsets) -> pa.Table:
        """Hash join of the two sides on (document, end), in the order of the tokens."""
        left, right = (pa.table({"key": ends(ids, offsets, lengths), f"at_{name}": np.arange(len(ids))})
                       for name, ids, offsets, lengths in (("a", a, a_offsets, self.sides.lengths[0]), ("b", b, b_offsets, self.sides.lengths[1])))
        return left.join(right, "key", join_type="inner", use_threads=False).sort_by("at_a").combine_chunks()


def _flat(parts: Sequence[bytes]) -> tuple[pa.Array, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
    return pa.array(np.frombuffer(b"".join(parts), np.int32)), offsets


def align(df: DataFrame, a: str, b: str, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus the LISTS of every whole text. ``a`` and ``b`` are the paths of the vocabularies."""
    check_model(b)
    return map_texts(df, keep, text, [field(name, "array<int>") for name in LISTS], lambda: Aligner(a, b), size=1 << 20)


def _parts(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a part holds, but for one long list, ``size`` elements of a list column."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _taken(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column and the offsets of its rows."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def digest(known: Sides, aligned: Sequence[pa.ListArray]) -> list:
    """n_a, n_b, n_groups, n_links, groups_sha256 and the links (places in ``Sides.pairs``) of the LISTS."""
    (a, a_at), (b, b_at), (a_sizes, groups), (b_sizes, _) = map(_taken, aligned)
    a_end, b_end = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
    pairs = pa.array(a[a_end - 1].astype(np.int64) * known.n_b + b[b_end - 1]).dictionary_encode()
    links = np.searchsorted(known.pairs, pairs.dictionary.to_numpy())[pairs.indices.to_numpy()].astype(np.int32)

    # Both sides in one sequence: a group's A tokens, then its B tokens.
    n_a, n_b = len(known.bytes[0]), known.n_b
    names = np.empty(len(a) + len(b), np.int64)
    group_a, group_b = np.repeat(np.arange(len(a_end)), a_sizes), np.repeat(np.arange(len(b_end)), b_sizes)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[a_end - 1], last_b[b_end - 1] = True, True
    names[np.arange(len(a)) + np.concatenate([[0], b_end])[group_a]] = a + n_a * last_a
    names[np.arange(len(b)) + a_end[group_b]] = 2 * n_a + b + n_b * last_b
    written_out = known.names.take(pa.array(names)).cast(pa.large_string())
    places = np.frombuffer(written_out.buffers()[1], np.int64) if len(names) else np.zeros(1, np.int64)
    data = memoryview(written_out.buffers()[2] or b"").cast("B")
    edges = places[a_at + b_at].tolist()
    sha = [hashlib.sha256(data[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(edges, edges[1:])]
    count = np.diff(groups)
    return [*(pa.array(x.astype(np.int64)) for x in (np.diff(a_at), np.diff(b_at), count, count)), pa.array(sha), lists(links, count)]


LINKED = (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), ("links", "array<int>"))


def linked(df: DataFrame, a: str, b: str, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep``, the counts and the digest of every aligned text, and ``links``, places in ``Sides.pairs``."""
    check_model(b)

    def start():
        work = Aligner(a, b)
        return lambda texts: digest(work.sides, work(texts))
    return map_texts(df, keep, text, [field(*x) for x in LINKED], start, size=1 << 20)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how often each pair is linked in all rows."""
    def run(batches):
        for part in _parts(batches, "links", 1 << 22):
            found = pa.table({"pair": pc.list_flatten(part.column("links"))}).group_by("pair", use_threads=False).aggregate([("pair", "count")])
            yield from found.rename_columns({"pair": "pair", "pair_count": "n"}).to_batches()

    return rows.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(rows: DataFrame, counts: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with n_best and count_sum in place of their links.

    The counts come to the driver: at most one row for each of ``Sides.pairs``."""
    known = sides(a, b)
    found = counts.toArrow()
    total = np.zeros(len(known.pairs), np.int64)
    total[found["pair"].to_numpy()] = found["n"].to_numpy()
    highest = np.zeros(known.n_b, np.int64)
    np.maximum.at(highest, known.pairs % known.n_b, total)
    sent = rows.sparkSession.sparkContext.broadcast((total, total == highest[known.pairs % known.n_b]))
    names = [c for c in rows.columns if c != "links"]
    schema = rows.select(*names).schema.add(field("n_best", "long")).add(field("count_sum", "long"))

    def run(batches):
        total, best = sent.value
        for part in _parts(batches, "links"):
            links, at = _taken(part.column("links"))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)])[at]) for x in (best, total)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *map(pa.array, sums)], names=schema.names)

    return rows.mapInArrow(run, schema)


def statistics(df: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(linked(docs, a, b, ["doc_id"]), "alignment")
    return scored(rows, pair_counts(rows), a, b).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
