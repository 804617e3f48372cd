"""Token ids of whole texts: by the tokenizers library over distinct words, or by tiktoken's merging.

A word-level tokenizer that drops white space cuts a text at white space in any case, and between a
letter and a comma or full stop, so the ids of the text are the ids of those pieces in a row. Pieces
are found and hashed with numpy; each worker keeps the ids of pieces by their 64-bit hash, and the
library encodes those that it has not seen. The store changes the speed only, never a result.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .textkit import BASE, FOLDED, RangeHash, Texts, sum_by

#: White space of the tokenizers' patterns (Unicode White_Space). Fixed values.
SPACES = (
    "\t-\r \x85\xa0\N{OGHAM SPACE MARK}\N{EN QUAD}-\N{HAIR SPACE}\N{LINE SEPARATOR}\N{PARAGRAPH SEPARATOR}"
    "\N{NARROW NO-BREAK SPACE}\N{MEDIUM MATHEMATICAL SPACE}\N{IDEOGRAPHIC SPACE}"
)
STORE_PIECES, STORE_IDS = 1_000_000, 16_000_000
#: Missing pieces go to the library in joined texts of about so many pieces.
JOINED = 4096

_loaded: dict = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the files stay outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts for a tokenizer that lower-cases, drops white space and cuts at it."""

    BETWEEN = "\n\x01\n"  # a word of its own between joined pieces; no other text yields its id

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        one, two = "Some", "wörds,"
        encode = lambda text: self.library.encode(text, add_special_tokens=False).ids
        if encode(f" {one}\n\t{two}  ") != encode(one.lower()) + encode(two[:-1]) + encode(","):
            raise ValueError("not a tokenizer that lower-cases, drops white space and cuts at it")
        (self.mark,) = encode(self.BETWEEN)
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.around = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        self.letter = np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library_ids(self, pieces: list[str]) -> list[np.ndarray]:
        if any("\x01" in p for p in pieces):
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(pieces, add_special_tokens=False)]
        ids = np.array(self.library.encode(self.BETWEEN.join(pieces), add_special_tokens=False).ids, np.uint32)
        found = np.split(ids, marks := np.flatnonzero(ids == self.mark))
        if len(marks) != len(pieces) - 1:
            raise ValueError("a piece yields the separator's id")
        return [found[0], *(x[1:] for x in found[1:])]

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        new = [x for k in range(0, len(pieces), JOINED) for x in self._library_ids(pieces[k : k + JOINED])]
        size = np.fromiter(map(len, new), np.int64, len(new))
        self.slot.update(zip(hashes, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *new])

    def encode_run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if any("<|" in t and self.around.search(t) for t in texts):
            return self._around_specials(texts)
        if len(self.slot) > STORE_PIECES or len(self.ids) > STORE_IDS:
            self._clear()
        t = Texts(texts)
        stops = np.flatnonzero((t.bytes[1:] == 44) | (t.bytes[1:] == 46)) + 1
        stops = stops[self.letter[t.bytes[stops - 1]]]
        begin, end = np.sort(np.concatenate([t.word_begin, stops])), np.sort(np.concatenate([t.word_end, stops]))
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        seen, first, which = np.unique(RangeHash(FOLDED[t.bytes], BASE)(begin, end), return_index=True, return_inverse=True)
        hashes = seen.tolist()
        get = self.slot.get
        slots = np.fromiter((get(h, -1) for h in hashes), np.int64, len(hashes))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            data, places = t.bytes.tobytes(), first[missing]
            pieces = [data[b:e].decode() for b, e in zip(begin[places].tolist(), end[places].tolist(), strict=True)]
            slots[missing] = np.arange(len(self.at), len(self.at) + len(missing))
            self._learn([hashes[k] for k in missing.tolist()], pieces)
        mine = slots[which]
        size = self.size[mine]
        place = np.repeat(self.at[mine] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.ids[place], sum_by(size, np.append(np.searchsorted(begin, t.begins), len(begin)))

    def _around_specials(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Special strings are taken out of a text before anything else; each is one id."""
        parts = [self.around.split(t) for t in texts]
        ids, counts = self.encode_run([x for p in parts for x in p[::2]])
        between, out, k = np.split(ids, np.cumsum(counts)[:-1]), [], 0
        for p in parts:
            found = []
            for n, x in enumerate(p):
                if n % 2:
                    found.append(np.array([self.library.token_to_id(x)], np.uint32))
                else:
                    found.append(between[k])
                    k += 1
            out.append(np.concatenate(found))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def word_encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


class ByteEncoder:
    """Ids of texts for a byte-level BPE file of the tokenizers library, by tiktoken's faster merging.

    Both take the same vocabulary, pattern and merge order, so the ids are the same; the file is
    refused unless its merges are in the order of their ids, which is what tiktoken goes by.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level BPE files")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("merges out of the order of their ids")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = len(vocabulary) + len(special)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids as uint32."""
        encode = self.encoding.encode_to_numpy
        return [encode(t, allowed_special="all", disallowed_special=()) for t in texts]


def byte_encoder(path: str) -> ByteEncoder:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteEncoder(path)
    return _loaded[path]
