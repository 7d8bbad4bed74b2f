"""Whole texts to ids with a public tokenizer, touching each distinct piece of text once.

A text is cut only where the tokenizer's own pre-tokenisation always cuts, whatever
stands on either side, so the ids of the cuts joined are the ids of the whole text. The
library encodes each distinct part between cuts; a worker keeps what it has encoded, up to
a fixed number of parts. Texts where a cut is not certain go to the library whole.

Plain Latin words need neither normalisation nor pre-tokenisation: they go straight to the
library's model, in the byte alphabet of its pre-tokenizer.

No texts give no ids; a null text is empty, and an empty one has no ids.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scorewatch.llm.words import split_words, strings

#: Distinct parts, and ids, that a worker keeps; beyond, it starts anew.
KEPT_PARTS, KEPT_IDS = 800_000, 8_000_000
_MINUS = itertools.repeat(-1)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + count) one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


class Encoder:
    """Ids of parts by `encode`, each kept after its first use."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.count = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32)
        self.entries = 0

    def _store(self, rows: list[list[int]]) -> np.ndarray:
        """Entry numbers of new id lists."""
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        n, total = self.entries + len(rows), self.used + int(counts.sum())
        while n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:total] = np.fromiter(itertools.chain.from_iterable(rows), np.int32, total - self.used)
        self.start[self.entries:n] = self.used + np.cumsum(counts) - counts
        self.count[self.entries:n] = counts
        entries = np.arange(self.entries, n)
        self.entries, self.used = n, total
        return entries

    def entry(self, parts: list[str]) -> np.ndarray:
        """Entry number of each part; new ones are encoded and kept."""
        found = np.fromiter(map(self.known.get, parts, _MINUS), np.int64, len(parts))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys(parts[i] for i in missing))
            self.known.update(zip(new, self._store(self.encode(new)).tolist(), strict=True))
            found[missing] = np.fromiter((self.known[parts[i]] for i in missing), np.int64, len(missing))
        return found

    def whole(self, texts: list[str], encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """Entries of texts that the library encodes whole; they are not looked up again."""
        return self._store(encode(texts))

    def ready(self) -> None:
        if len(self.known) > KEPT_PARTS or self.used > KEPT_IDS:
            self.clear()

    def gather(self, entries: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids) for texts of `per_text` entries each."""
        counts = self.count[entries].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.concatenate([[0], np.cumsum(per_text)])
        return np.diff(ends[at]), self.ids[ragged(self.start[entries], counts)]


#: Stands for a cut inside an item; items that hold it are cut in Python.
SEP = "\x01"
_STOP = re.compile(r"[^\W\d_]([.,]+)$")
#: A white-space character other than a blank, alone between others, is a pre-token of its own.
_ALONE = re.compile(r"(?<!\s)([\t-\r])(?!\s)")


def cut_item(item: str, lines: bool) -> list[str]:
    """The parts of one item, whatever it holds."""
    out = []
    for p in _ALONE.split(item) if lines else [item]:
        m = _STOP.search(p)
        out += [p[:m.start(1)], m[1]] if m else [p]
    return out


def cut_items(items: pa.Array, lines: bool) -> tuple[np.ndarray, pa.Array]:
    """(parts per item, all parts). Full stops and commas behind a last letter are a pre-token of
    their own; with `lines`, so is a line feed (items then hold no two white-space characters
    side by side)."""
    if pc.any(pc.match_substring(items, SEP)).as_py():
        lists = pa.array([cut_item(x, lines) for x in strings(items)], pa.list_(pa.string()))
    else:
        if lines:
            items = pc.replace_substring(items, "\n", f"{SEP}\n{SEP}")
        lists = pc.split_pattern(pc.replace_substring_regex(items, r"(\pL)([.,]+)(\x01|$)", rf"\1{SEP}\2\3"), SEP)
    return pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()


#: The byte alphabet of byte-level pre-tokenizers: bytes that are no visible sign of Latin-1
#: stand in order from character 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_ALPHABET = {b: 256 + i for i, b in enumerate(_HIDDEN)}
BLANK = chr(_ALPHABET[ord(" ")])


class Library:
    """The tokenizers library on whole texts and on parts."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tok, self.lower = Tokenizer.from_file(path), lower
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tok.model

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts. A plain word is letters below U+0250, with a blank in front or not: composed,
        one pre-token, and alike in every version of Unicode."""
        tokenize, lower, rest = self.model.tokenize, self.lower, []
        out: list = [None] * len(parts)
        for i, part in enumerate(parts):
            word = part.lower() if lower else part
            bare = word[1:] if word[:1] == " " else word
            if not bare.isalpha():
                rest.append(i)
            elif word.isascii():
                out[i] = [t.id for t in tokenize(word if bare is word else BLANK + bare)]
            elif max(bare) < "ɐ":
                out[i] = [t.id for t in tokenize(word.encode().decode("latin-1").translate(_ALPHABET))]
            else:
                rest.append(i)
        for i, ids in zip(rest, self.whole([parts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


_OWN: dict[tuple[str, str], Encoder] = {}


def _own(kind: str, path: str, make: Callable[[], Encoder]) -> Encoder:
    """This worker's encoder: a worker serves many tasks."""
    if (kind, path) not in _OWN:
        _OWN[kind, path] = make()
    enc = _OWN[kind, path]
    enc.ready()
    return enc


def _spread(per_item: np.ndarray, parts: np.ndarray, codes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the parts of the items `codes`, and how many of them each text has. `parts`
    holds the entries of all items one after another, `per_item` of them each."""
    n = per_item[codes]
    ends, at = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(per_text)])
    return parts[ragged((np.cumsum(per_item) - per_item)[codes], n)], np.diff(ends[at])


def encode_word_bpe(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids per text, all ids) of a tokenizer that drops white space and lower-cases: every
    ASCII white-space character is a cut."""
    enc = _own("word", path, lambda: Encoder(Library(path, lower=True).parts))
    counts, codes, dictionary = split_words(texts)
    items = pc.if_else(pc.string_is_ascii(dictionary), pc.ascii_lower(dictionary), dictionary)
    per_item, parts = cut_items(items, lines=False)
    return enc.gather(*_spread(per_item, enc.entry(strings(parts)), codes, counts))


def encode_byte_bpe(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids per text, all ids) of a byte-level tokenizer whose pre-tokens are a blank with what
    follows: a blank is a cut unless white space stands next to it."""
    def make() -> Encoder:
        lib = Library(path, lower=False)
        enc = Encoder(lib.parts)
        enc.lib = lib
        return enc

    enc = _own("byte", path, make)
    texts = pc.fill_null(texts, "")
    unsure = pc.match_substring_regex(texts, r"[\s\v\x{85}\pZ][\s\v\x{85}\pZ]").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.if_else(pa.array(unsure), "", texts), " ")
    per_text = pc.list_value_length(lists).to_numpy().astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    first = np.cumsum(per_text) - per_text
    # Items are a blank with what follows it, then the first item of each text without one.
    items = pa.concat_arrays([pc.binary_join_element_wise(" ", coded.dictionary, ""), flat.take(pa.array(first))])
    codes = coded.indices.to_numpy().astype(np.int64)
    codes[first] = len(coded.dictionary) + np.arange(len(texts))
    per_item, parts = cut_items(items, lines=True)
    entries = enc.entry(strings(parts))
    if unsure.any():  # such a text is one item of one part
        at = (np.cumsum(per_item) - per_item)[codes[first[unsure]]]
        entries[at] = enc.whole(strings(texts.filter(pa.array(unsure))), enc.lib.whole)
    return enc.gather(*_spread(per_item, entries, codes, per_text))


def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_cuts_are_sure(sp) -> bool:
    """No piece goes on after a blank, so no merge crosses the place before one."""
    mark = "▁"
    return all(mark not in sp.id_to_piece(i).lstrip(mark) for i in range(sp.get_piece_size()))


def encode_pieces(path: str, texts: pa.Array, normal: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids per text, all ids) of a sentencepiece model. `normal`: normalisation only adds one
    mark in front and turns blanks into marks; other models take whole texts."""
    def make() -> Encoder:
        sp = _sentencepiece(path)
        enc = Encoder(lambda xs: sp.encode(xs, num_threads=1))
        enc.sure = piece_cuts_are_sure(sp)
        return enc

    enc = _own("piece", path, make)
    texts = pc.fill_null(texts, "")
    if normal and enc.sure:
        unsure = pc.match_substring_regex(texts, "^ | $|  |▁|^$").to_numpy(zero_copy_only=False)
    else:
        unsure = np.ones(len(texts), bool)
    lists = pc.split_pattern(pc.if_else(pa.array(unsure), "", texts), " ")
    per_text = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    entries = enc.entry(strings(coded.dictionary))[coded.indices.to_numpy()]
    if unsure.any():
        entries[(np.cumsum(per_text) - per_text)[unsure]] = enc.whole(strings(texts.filter(pa.array(unsure))), enc.encode)
    return enc.gather(entries, per_text)
