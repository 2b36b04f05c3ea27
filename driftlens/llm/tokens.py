"""Token ids of whole texts by a public tokenizer file, each distinct part of a word given to the library once.

The tokenizers library gives every id. Where a tokenizer drops white space and then splits letters, digits and signs,
no id depends on more than one such part, so the parts of a batch are told apart by 64-bit hashes and only parts that
the worker has not seen reach the library. Runs with anything unusual (apostrophes, special tokens, characters other
than ASCII and the letters of Latin-1) are parts as a whole and take the library's full way.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pandas as pd

from driftlens.llm.wordhash import SPAN, stretch_hashes

# The normalizer steps and the word pattern of the public file for which parts are independent.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Parts kept per worker process. Bounds memory only: what is dropped is encoded again.
KEPT_PARTS = 2_000_000

SPACE, LETTER, DIGIT, SIGN, ODD = 0, 1, 2, 3, 4
_KIND = np.full(256, ODD, np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[[0x20, 9, 10, 11, 12, 13]] = SPACE
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("a") : ord("z") + 1] = LETTER
_KIND[ord("A") : ord("Z") + 1] = LETTER
_KIND[ord("'")] = ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Encoder:
    """Encodes UTF-8 texts to ids of ``dtype``, the narrowest that holds the vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        steps = [step["type"] for step in (layout.get("normalizer") or {}).get("normalizers", [])]
        splits = (layout.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_part = (
            steps == NORMALIZERS
            and bool(splits)
            and splits[0].get("pattern", {}).get("Regex") == PATTERN
            and splits[0].get("behavior") == "Removed"
            and splits[0].get("invert") is True
        )
        self.first_signs = {token["content"].encode()[:2] for token in layout.get("added_tokens") or []}
        # For parts that are already normalised and split.
        self.parts_library = Tokenizer.from_file(path)
        self.parts_library.normalizer = normalizers.Sequence([])
        self.parts_library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes, and where their ids are
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if not self.by_part:
            whole = [raw.decode("utf-8", "replace") for raw in raws]
            lists = [np.asarray(e.ids, self.dtype) for e in self.library.encode_batch(whole, add_special_tokens=False)]
            counts = np.array([len(own) for own in lists], np.int64)
            return (np.concatenate(lists) if lists else np.zeros(0, self.dtype)), counts
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        text_ends = np.cumsum(np.array([len(raw) + 1 for raw in raws], np.int64))
        starts, lengths, plain, data = self._parts(data)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(raws), np.int64)
        hashes = stretch_hashes(data, starts, lengths)
        words = data[starts] != 0x0A  # white space is folded to line ends
        starts, lengths, plain, hashes = starts[words], lengths[words], plain[words], hashes[words]
        codes, distinct = pd.factorize(hashes)
        order = np.argsort(distinct)
        ranked = distinct[order]
        place = self._places(ranked)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            if len(self.known) + len(unknown) > KEPT_PARTS:
                self._forget()
                unknown = np.arange(len(ranked))
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            where = first[order[unknown]]
            self._learn(ranked[unknown], data, starts[where], lengths[where], plain[where])
            place = self._places(ranked)
        by_code = np.empty(len(distinct), np.int64)
        by_code[order] = place
        part = by_code[codes]
        sizes = self.size[part]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.at[part] - (ends - sizes), sizes)
        source += np.arange(total, dtype=np.int64)
        upto = np.searchsorted(starts, text_ends, side="left")
        ends_by_text = np.concatenate([[0], ends])[upto]
        return self.ids[source], np.diff(ends_by_text, prepend=0)

    def _parts(self, data: np.ndarray):
        """Starts, lengths and plainness of the parts, and the bytes in lower case; white space is a part as well."""
        kind = _KIND[data]
        lower = _LOWER[data]
        # Letters of Latin-1 in UTF-8: C3 80..BF but for the signs C3 97 and C3 B7.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        if len(lead):
            second = data[lead + 1]
            letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
            kind[lead[letter]] = LETTER
            kind[lead[letter] + 1] = LETTER
            upper = lead[letter & (second <= 0x9E)] + 1
            lower[upper] += 0x20
        for signs in self.first_signs:
            if len(signs) == 2:
                kind[:-1][(data[:-1] == signs[0]) & (data[1:] == signs[1])] = ODD
        space = kind == SPACE
        lower[space] = 0x0A
        runs = np.flatnonzero(np.concatenate([[True], space[1:] != space[:-1]]))
        run_sizes = np.diff(np.append(runs, len(data)))
        odd_run = np.maximum.reduceat(kind, runs) == ODD
        odd_run |= run_sizes > SPAN
        if odd_run.any():
            odd = np.repeat(odd_run, run_sizes)
            kind[odd] = ODD
            lower[odd] = data[odd]
        edge = kind[1:] != kind[:-1]
        edge |= kind[1:] == DIGIT
        starts = np.flatnonzero(np.concatenate([[True], edge]))
        lengths = np.diff(np.append(starts, len(data)))
        return starts, lengths, kind[starts] != ODD, lower

    def _places(self, ranked: np.ndarray) -> np.ndarray:
        """Where sorted hashes are among the known ones, -1 if nowhere."""
        if not len(self.known):
            return np.full(len(ranked), -1, np.int64)
        place = np.searchsorted(self.known, ranked)
        place[place == len(self.known)] = 0
        return np.where(self.known[place] == ranked, place, -1)

    def _learn(self, hashes, data, starts, lengths, plain) -> None:
        found: list = [None] * len(hashes)
        for usual, library in ((True, self.parts_library), (False, self.library)):
            chosen = np.flatnonzero(plain == usual)
            strings = [
                data[a : a + n].tobytes().decode("utf-8", "replace")
                for a, n in zip(starts[chosen].tolist(), lengths[chosen].tolist())
            ]
            for i, encoding in zip(chosen.tolist(), library.encode_batch_fast(strings, add_special_tokens=False)):
                found[i] = encoding.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for own in found for x in own), self.dtype, int(sizes.sum()))
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, flat])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, sizes])[order]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
