"""Offset-preserving encoding and decoding with a sentencepiece model.

Normalisation follows the model's own specification: at each place the longest key of the
compiled character map (a double-array trie) is replaced by its value, else one character
is taken as it is; every normalised byte remembers the source byte it came from. The
lengths of the pieces cut the normalised bytes, and the remembered places project each
piece to a span of the original bytes. A piece that ends elsewhere than the normalised
text is an error, not a guess.

Defined cases: null text is empty and has the end id only; a text of any length is
encoded whole; equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from scorewatch.llm.common import as_batch, slices, table
from scorewatch.llm.encoders import encode_pieces

MARK = "▁".encode()


class CharMap:
    """Compiled character map: 4 bytes of trie size, trie units, then zero-ended values."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.values = blob[4 + size:]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key at `at`."""
        if not self.units:
            return None
        node, best = self._child(self.units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = self.units[node] if node < len(self.units) else 0
            if (unit & 0x800000FF) != raw[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.values[value:self.values.index(0, value)]
        return best


class Normaliser:
    """Normalisation with source alignment as the model file specifies it."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = m.trainer_spec.treat_whitespace_as_suffix
        #: Only a mark in front, and marks for blanks.
        self.plain = not self.map.units and self.prefix and self.escape and not self.squeeze and not self.suffix

    def _unit(self, raw: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(raw, at)
        if hit:
            return hit
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, raw[at:at + n]

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """(normalised bytes, source byte of each of them and of the end)."""
        raw, at = text.encode(), 0
        mark = MARK if self.escape else b" "
        if self.squeeze:
            while at < len(raw):
                n, out = self._unit(raw, at)
                if out != b" ":
                    break
                at += n
        if at == len(raw):
            return b"", [at]
        norm, source = bytearray(), []

        def add(piece: bytes, place: int) -> None:
            norm.extend(piece)
            source.extend([place] * len(piece))

        if self.prefix and not self.suffix:
            add(mark, at)
        blank = self.squeeze
        while at < len(raw):
            n, out = self._unit(raw, at)
            while blank and out.startswith(b" "):
                out = out[1:]
            for c in out.decode(errors="replace"):
                add(mark if c == " " else c.encode(), at)
            if out:
                blank = self.squeeze and out.endswith(b" ")
            at += n
        end = at
        if self.squeeze:
            while norm.endswith(mark):
                end = source[-len(mark)]
                del norm[-len(mark):], source[-len(mark):]
        if self.prefix and self.suffix:
            add(mark, end)
        return bytes(norm), [*source, end]


class Pieces:
    """A model's piece lengths in normalised bytes, beside its normaliser and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.path, self.sp = path, sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normaliser = Normaliser(model)
        n = self.sp.get_piece_size()
        if not any(self.sp.is_byte(i) for i in range(n)):
            raise ValueError("spans need a model whose unknown characters fall back to bytes")
        self.length = np.array([0 if self.sp.is_control(i) else 1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(n)], np.int64)

    def spans(self, texts: pa.Array, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans [start, end) of all pieces, relative to their text."""
        ends = np.cumsum(self.length[ids])
        begins = ends - self.length[ids]
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        if self.normaliser.plain:
            # One pass over the bytes of all texts: a mark of three bytes in front, three for a blank.
            buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
            off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            raw = buf[off[0]:off[-1]]
            width = np.where(raw == 0x20, 3, 1)
            total = np.concatenate([[0], np.cumsum(width)])
            lo, hi = off[:-1] - off[0], off[1:] - off[0]
            norm = total[hi] - total[lo] + 3 * (sizes > 0)
            place = np.concatenate([[0], np.cumsum(norm)])  # where each text's normalised bytes begin
            byte_at = np.cumsum(width) - width - np.repeat(total[lo], sizes) + np.repeat(place[:-1] + 3, sizes)
            source = np.zeros(place[-1] + 1, np.int64)
            local = np.arange(len(raw)) - np.repeat(lo, sizes)
            for k in range(3):
                sel = width > k
                source[byte_at[sel] + k] = local[sel]
        else:
            done = [self.normaliser(t) for t in texts.to_pylist()]
            norm = np.array([len(x) for x, _ in done], np.int64)
            place = np.concatenate([[0], np.cumsum(norm)])
            source = np.array([s for _, al in done for s in al[:-1]] + [0], np.int64)
            sizes = np.array([al[-1] for _, al in done], np.int64)
        last = np.cumsum(counts)
        got = np.concatenate([[0], ends])[last]
        if not np.array_equal(got, place[1:]):
            raise ValueError("pieces do not cover the normalised text")
        owner = np.repeat(np.arange(len(counts)), counts)
        stop = np.where(ends == place[owner + 1], sizes[owner], source[ends])
        return source[begins], stop


_OWN: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _OWN:
        _OWN[path] = Pieces(path)
    return _OWN[path]


def encode_with_spans(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids per text, all ids, span starts, span ends), without an end id."""
    texts = pc.fill_null(texts, "")
    p = _pieces(path)
    counts, ids = encode_pieces(path, texts, p.normaliser.plain)
    return (counts, ids, *p.spans(texts, counts, ids))


def _encode(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            counts, ids, lo, hi = encode_with_spans(path, b.column("text"))
            off = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (ids, lo, hi)]
            yield as_batch(schema, [b.column("doc_id"), *lists])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends): pieces of every whole text and their original byte spans."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def _digest(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _pieces(path).sp
        end, names = sp.eos_id(), [str(i) for i in range(sp.get_piece_size())]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches, "text"):
            counts, flat, lo, hi = encode_with_spans(path, b.column("text"))
            both, at, rows = np.stack([lo, hi], 1).astype("<i8"), 0, ([], [], [])
            for n in counts.tolist():
                ids = [*flat[at:at + n].tolist(), end]
                rows[0].append(sha(" ".join([names[i] for i in ids])))
                rows[1].append(sha(sp.decode(ids)))
                rows[2].append(zlib.crc32(both[at:at + n].tobytes()))
                at += n
            yield as_batch(schema, [b.column("doc_id"), counts + 1, *rows])

    return run


def q_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digest(public_tokenizers.path("piece_bpe_32k.model")),
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


QUERIES = {"op4_piece_offsets": q_pieces}
ORACLE: dict[str, str] = {}
