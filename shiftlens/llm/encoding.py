"""Token ids of whole texts from a public tokenizer file, in Arrow batches.

Where a tokenizer cuts texts at white space before anything else, the ids of a text
are the ids of its white-space chunks in order. A batch is then split by Arrow,
each different chunk is given to the tokenizers library once, as it stands, and the
ids are gathered by numpy. Chunks are cut at ASCII white space only. Whether a
tokenizer works so is tried when its file is read. Texts that hold the opening of a
special token, and all texts for other tokenizers, go to the library whole. NULL counts as empty, and an empty batch gives no ids.
"""

from __future__ import annotations

import os
import string
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Cut off where the tokenizer parts a full stop or comma from the letter before it.
PARTED = r"([A-Za-z])([.,])([ \t\n\v\f\r]|$)"
MARK = "\x00"
MOST_CHUNKS = 500_000


class ChunkEncoder:
    """Encodes lists of texts; keeps the ids of up to ``MOST_CHUNKS`` chunks per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark_id,) = self._ids(MARK)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends_word[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        self.words_end = bool(suffix)
        apart = [self._ids(t) for t in ("Ab", "c.", "d")]
        self.at_spaces = np.array_equal(self._ids(" Ab c.\r\n\t d"), np.concatenate(apart))
        self.parts_stops = all(self._parted(letter + stop) for letter in string.ascii_letters for stop in ".,")
        self._forget()

    def _parted(self, text: str) -> bool:
        """Whether the last character becomes a piece of its own before any merge."""
        cut = self.tokenizer.pre_tokenizer
        return cut is not None and len(text) - 1 in {span[0] for _, span in cut.pre_tokenize_str(text)}

    def _ids(self, text: str) -> np.ndarray:
        """Ids alone; the library's call for this skips the places of the tokens in the text."""
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, np.uint32)

    def _forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.start = np.zeros(1, np.int64)
        self.size = np.zeros(1, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _places(self, chunks: pa.LargeStringArray) -> np.ndarray:
        """Place of each different chunk among the known ones; those not met before are learned."""
        if len(self.known) > MOST_CHUNKS:
            self._forget()
        place = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = chunks.take(pa.array(new))
            word = pc.and_(pc.ascii_is_alpha(fresh), self.words_end).to_numpy(zero_copy_only=False)
            marked = pc.match_substring(fresh, MARK).to_numpy(zero_copy_only=False)
            kind = np.where(word, 0, np.where(marked, 2, 1))
            order = np.argsort(kind, kind="stable")
            place[new[order]] = len(self.known) + np.arange(len(new))
            self._learn(*(fresh.take(pa.array(np.flatnonzero(kind == k))) for k in range(3)))
        return place

    def _learn(self, words: pa.Array, plain: pa.Array, odd: pa.Array) -> None:
        """Few calls for all new chunks.

        A chunk of ASCII letters is one word, whose last id alone carries the end of
        word where the tokenizer has one. Between the others stands a mark whose id no
        chunk holds; chunks that hold the mark go one by one.
        """
        flat, size = [self.store], [self.size]
        if len(words):
            ids = self._ids(" ".join(words.to_pylist()))
            flat.append(ids)
            size.append(np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1))
        if len(plain):
            ids = self._ids(f" {MARK} ".join([*plain.to_pylist(), ""]))
            flat.append(ids[ids != self.mark_id])
            size.append(np.diff(np.flatnonzero(ids == self.mark_id), prepend=-1) - 1)
        for c in odd.to_pylist():
            flat.append(self._ids(c))
            size.append(np.array([len(flat[-1])]))
        self.known = pa.concat_arrays([self.known, words, plain, odd])
        self.store, self.size = np.concatenate(flat), np.concatenate(size)
        if len(self.size) != len(self.known):
            raise ValueError("the tokenizer does not cut texts at white space")
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row with ``end_id`` after each text, and the ids per text; NULL counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.or_(pc.match_substring(texts, "<|"), not self.at_spaces)
        flat, lengths = self._encode_chunks(pc.if_else(whole, "", texts), end_id)
        places = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(places):
            return flat, lengths
        ends, parts, done = np.cumsum(lengths), [], 0
        for k in places:
            ids = self._ids(texts[k].as_py())
            parts += [flat[done : ends[k] - 1], ids]
            done = ends[k] - 1
            lengths[k] += len(ids)
        return np.concatenate([*parts, flat[done:]]), lengths

    def _encode_chunks(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if self.parts_stops:
            texts = pc.replace_substring_regex(texts, PARTED, r"\1 \2\3")
        parts = pc.ascii_split_whitespace(texts)
        chunks = parts.flatten().dictionary_encode()
        index = self._places(chunks.dictionary)[chunks.indices.to_numpy()]
        size = self.size[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(self.start[index] - ends[:-1], size) + np.arange(ends[-1])
        offsets = parts.offsets.to_numpy().astype(np.int64)
        bounds = ends[offsets - offsets[0]]
        flat = np.insert(self.store[gather], bounds[1:], np.uint32(end_id))
        return flat, np.diff(bounds) + 1


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file, loaded once and kept between tasks."""
    kept = sys.modules.setdefault("shiftlens_worker_cache", types.ModuleType("shiftlens_worker_cache")).__dict__
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept[path] = ChunkEncoder(path)
    return kept[path]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
