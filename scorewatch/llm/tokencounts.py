"""Token counts of whole texts from the lengths of their pre-tokens, without shuffling one.

A text is cut only where the tokenizer's pre-tokenisation always cuts, so a text has as many
tokens as its parts together. Two tiers know the tokens of a part:

1. a compact hash table of the most frequent parts of all texts, which every task gets. Each
   task keeps a Misra-Gries summary of the parts of its texts (`SUMMARY` counters); only the
   summaries are added up, and the `FREQUENT` largest sums are encoded once, on the driver. The
   table has a fixed number of entries, so its size does not grow with the texts;
2. a cache in each worker (at most `KEPT` parts), filled by the tokenizer with what the table
   does not know.

The parts of the table are a matter of speed alone: counts are exact whatever it holds. Its keys
are 128-bit hashes.

Where a cut is not certain (a tokenizer of another kind, or one whose special strings hold white
space), texts go to the library whole. Special strings inside texts are handled as the
library does by default; nothing is truncated or padded.

Defined cases: a null text is empty (no bytes, no tokens); repeated rows and ids are rows of
their own; an empty table gives no rows; other columns come back in `row`, so names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import bundled, extended, slices, table
from scorewatch.llm.encoders import Library, cut_items, ragged
from scorewatch.llm.words import strings

SUMMARY, FREQUENT, KEPT = 8_192, 32_768, 400_000
#: Longer parts are neither summarised nor kept.
MAX_PART_BYTES = 64
LIMIT = 1024

_SURE_BLANK = re.compile(r"(?<=\S)(?= \S)")
_TWO_SPACES = r"[\s\v\x{85}\pZ][\s\v\x{85}\pZ]"


def cuts_at_blanks(path: str) -> bool:
    """Whether a blank between two other characters always begins a pre-token: byte-level
    tokenizers with the usual pattern, no normaliser, and special strings without white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j.get("pre_tokenizer") or {}
    plain = all(not re.search(r"[\s.,]", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in j["added_tokens"])
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not j.get("normalizer") and plain


def cut_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(parts per text, code of each part, distinct parts). A part is a blank with what follows it
    up to the next blank, without its last full stops and commas; line feeds stand alone. Where
    white space stands side by side, a text is cut only at blanks between two other characters."""
    unsure = pc.match_substring_regex(texts, _TWO_SPACES).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.if_else(pa.array(unsure), "", texts), " ")
    per_text = pc.list_value_length(lists).to_numpy().astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    first = np.cumsum(per_text) - per_text
    items = pa.concat_arrays([pc.binary_join_element_wise(" ", coded.dictionary, ""), flat.take(pa.array(first))])
    codes = coded.indices.to_numpy().astype(np.int64)
    codes[first] = len(coded.dictionary) + np.arange(len(texts))
    per_item, parts = cut_items(items, lines=True)
    # What stands for an unsure text so far is one empty item; its parts come behind all others.
    rest = [_SURE_BLANK.split(t) for t in strings(texts.filter(pa.array(unsure)))]
    n_rest = np.fromiter(map(len, rest), np.int64, len(rest))
    n = per_item[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    per_text = np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])
    coded = pa.concat_arrays([parts, pa.array([p for x in rest for p in x], parts.type)]).dictionary_encode()
    places = ragged((np.cumsum(per_item) - per_item)[codes], n)
    if rest:
        starts, counts = np.cumsum(per_text) - per_text, per_text.copy()
        starts[unsure], counts[unsure] = len(places) + np.cumsum(n_rest) - n_rest, n_rest
        places = np.concatenate([places, len(parts) + np.arange(n_rest.sum())])[ragged(starts, counts)]
        per_text = counts
    return per_text, coded.indices.to_numpy().astype(np.int64)[places], strings(coded.dictionary)


def whole_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Every text as one part."""
    coded = texts.dictionary_encode()
    return np.ones(len(texts), np.int64), coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary)


def token_lengths(path: str) -> Callable[[list[str]], list[int]]:
    """Tokens of each part, by the library of the file at `path`."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda parts: [len(x) for x in sp.encode(parts, num_threads=1)]
    if cuts_at_blanks(path):
        lib = Library(path, lower=False)
        lib.tok.encode_special_tokens = False
        lib.tok.no_truncation()
        lib.tok.no_padding()
        return lambda parts: [len(x) for x in lib.parts(parts)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda parts: [len(e.ids) for e in tok.encode_batch_fast(parts, add_special_tokens=False)]


def digests(parts: list[str]) -> np.ndarray:
    """128-bit hashes as pairs of words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.uint64).reshape(-1, 2)


class LengthTable:
    """Lengths under 128-bit keys, by open addressing with linear probing: 20 bytes a slot and
    at most half of the slots taken. Length 0 marks a free slot."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.length = np.zeros((size, 2), np.uint64), np.zeros(size, np.uint32)
        left, slot = np.arange(len(keys)), keys[:, 0] & self.mask
        while len(left):
            _, one = np.unique(slot, return_index=True)  # one of those that want a slot
            free = one[self.length[slot[one]] == 0]
            self.keys[slot[free]], self.length[slot[free]] = keys[left[free]], lengths[left[free]]
            stay = np.ones(len(left), bool)
            stay[free] = False
            left, slot = left[stay], (slot[stay] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Length under each key, 0 where there is none."""
        out, left, slot = np.zeros(len(keys), np.int64), np.arange(len(keys)), keys[:, 0] & self.mask
        while len(left):
            length = self.length[slot].astype(np.int64)
            hit = (length > 0) & (self.keys[slot] == keys[left]).all(axis=1)
            out[left[hit]] = length[hit]
            on = (length > 0) & ~hit
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out


def shrink(kept: Counter, size: int) -> Counter:
    """A Misra-Gries step: the largest `size` counters, lowered by the largest one that goes."""
    if len(kept) <= size:
        return kept
    counts = np.fromiter(kept.values(), np.int64, len(kept))
    least = int(np.partition(counts, -size - 1)[-size - 1])
    return Counter({p: n - least for p, n in kept.items() if n > least})


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: Counter = Counter()
    for b in slices(batches, "text"):
        _, codes, parts = cut_texts(pc.fill_null(b.column("text"), ""))
        for p, n in zip(parts, np.bincount(codes, minlength=len(parts)).tolist(), strict=True):
            if p:
                kept[p] += n
        if len(kept) > 16 * SUMMARY:
            kept = shrink(kept, 4 * SUMMARY)
    kept = shrink(Counter({p: n for p, n in kept.items() if len(p.encode()) <= MAX_PART_BYTES}), SUMMARY)
    if kept:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})


def frequent_parts(docs: DataFrame) -> list[str]:
    """The parts with the largest counts over all texts, as the tasks' summaries give them."""
    sums = docs.select("text").mapInArrow(_summarise, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return [r.part for r in sums.orderBy(F.desc("n"), "part").limit(FREQUENT).collect()]


def length_table(docs: DataFrame, path: str) -> LengthTable:
    parts = frequent_parts(docs) if cuts_at_blanks(path) else []
    return LengthTable(digests(parts), np.array(token_lengths(path)(parts), np.uint32))


class Lengths:
    """A worker's cache of what the table does not know."""

    def __init__(self, path: str):
        self.encode, self.cut = token_lengths(path), cut_texts if cuts_at_blanks(path) else whole_texts
        self.known: dict[str, int] = {"": 0}

    def of(self, parts: list[str], frequent: LengthTable) -> np.ndarray:
        out = frequent.find(digests(parts))
        missing = np.flatnonzero(out == 0).tolist()
        found = list(map(self.known.get, map(parts.__getitem__, missing)))
        new = [parts[i] for i, n in zip(missing, found, strict=True) if n is None]
        lengths = self.encode(new)
        it = iter(lengths)
        out[missing] = [next(it) if n is None else n for n in found]
        if len(self.known) + len(new) > KEPT:
            self.known = {"": 0}
        self.known.update((p, n) for p, n in zip(new[:KEPT], lengths, strict=False) if len(p) <= MAX_PART_BYTES)
        return out


_OWN: dict[str, Lengths] = {}


def _count(path: str, frequent, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _OWN:  # a worker serves many tasks
            _OWN[path] = Lengths(path)
        own = _OWN[path]
        for b in slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "")
            per_text, codes, parts = own.cut(texts)
            ends = np.concatenate([[0], np.cumsum(own.of(parts, frequent.value)[codes])])
            n = np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])
            yield pa.RecordBatch.from_pydict({
                "row": b.column("row"), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return run


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(row, n_bytes, n_tokens, over_limit) of every row of `docs`; `row` holds its columns but the text."""
    frequent = docs.sparkSession.sparkContext.broadcast(length_table(docs, path))  # FREQUENT entries at most
    rows = bundled(docs)
    return rows.mapInArrow(_count(path, frequent, limit), extended(rows.select("row").schema, "n_bytes long, n_tokens long, over_limit boolean"))


def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counted(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op12_token_counts": q_counts}
ORACLE: dict[str, str] = {}
