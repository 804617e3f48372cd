"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic transducers replace the tokenizer:

* the *splitter* reads character classes (with one character of look-ahead folded into the class)
  and emits 1 where a pre-token begins. It has 8 states. Text is cut into chunks of equal length;
  each chunk's map from every start state to its end state is found for all chunks in lockstep, and
  the maps compose through a parallel prefix scan, which gives every chunk its true start state.
* the *counter* reads bytes and the splitter's marks; a mark takes it back to its start. The annotation
  of a transition is the change that the byte makes to the number of tokens (it may be negative, when
  a merge takes tokens together). A state is the set of open vocabulary-trie nodes, each with the last
  token before it and the count there. Merging is decided by one fact of BPE: a sequence of tokens is
  the encoding of its bytes when every neighbouring pair is, so exactly one token that ends at a byte
  is compatible with the last token of what is before it. Its chunks are composed in the same way: from
  the first mark of a chunk on, state and counts do not depend on what is before, so the map of a
  chunk with a mark is a constant. Chunks without one, inside long pre-tokens, have maps over the few
  states that can reach them, which compose through a prefix scan; if there are too many such states,
  these chunks are walked one after the other. Last, all chunks are walked from their true states up
  to their first marks.

States are made when they are first reached, as in a lazy DFA. When there are more than MAX_STATES, all
go but those in which chunks just are; that is looked at after each step and changes speed only. Long
texts are cut where a pre-token must begin, before white space after a letter, digit or stop.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings of the tokenizer
inside a text count as one token each (the library's default); repeated rows are counted each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, column, documents, filled, runs
from .tokens import SPACES, tokenizer_path

QUERY = "op2_token_counts"
LIMIT = 1024
CHUNK = 256
MAX_STATES = 100_000
#: States that may reach chunks without a mark, for their maps.
MAP_STATES = 16
#: Texts of more characters are cut; this many characters are counted at once.
PART = 1 << 20
#: The counter's state at the beginning of a pre-token, and that of a chunk before its first mark.
START, OPEN = 0, 1

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Behind such a character a pre-token begins, as white space follows.
SURE_BEGIN = re.compile(r"[A-Za-z0-9.,;:?](?=[ \n\t])")

# Symbols of the splitter: other, letter, number, white space inside a run (space or not), the last
# white space before something else (space or not), apostrophe of a contraction of 2 or 3
# characters, end of a text.
OTHER, LETTER, NUMBER, IN_SPACE, LAST_SPACE, LAST_BLANK, SHORT, LONG, END = range(9)
# States: at a fresh start, in a run of other, letters, numbers, white space, after a space that
# joins the next run, one or two characters before the end of a contraction.
FRESH, OTHERS, LETTERS, NUMBERS, BLANKS, JOIN, ONE, TWO = range(8)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and begins[state, symbol]."""
    to = np.zeros((8, 9), np.uint8)
    begins = np.ones((8, 9), np.uint8)
    to[:] = [OTHERS, LETTERS, NUMBERS, BLANKS, JOIN, FRESH, ONE, TWO, FRESH]
    for state, symbol in ((OTHERS, OTHER), (LETTERS, LETTER), (NUMBERS, NUMBER), (BLANKS, IN_SPACE)):
        begins[state, symbol] = 0
    for symbol in (SHORT, LONG):  # an apostrophe inside a run of others stays there
        to[OTHERS, symbol] = to[JOIN, symbol] = OTHERS
        begins[OTHERS, symbol] = 0
    begins[JOIN] = 0
    to[ONE], begins[ONE] = FRESH, 0
    to[TWO], begins[TWO] = ONE, 0
    begins[:, END], to[:, END] = 1, FRESH
    return to, begins


def character_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or IN_SPACE for every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (IN_SPACE, f"[{SPACES}]+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


class Counter:
    """The lazily determinised counting transducer of one vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], max_states: int = MAX_STATES):
        self.rank = {(vocabulary[a], vocabulary[b]): k for k, (a, b) in enumerate(merges)}
        never = len(merges)
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(merges):
            t = vocabulary[a + b]
            if t in self.made:
                raise ValueError("a token with two merges has no single derivation")
            self.made[t] = (vocabulary[a], vocabulary[b], k)
        self.spines: tuple[dict, dict] = {}, {}
        self.never = never
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        # Trie: children by (node * 256 + byte); token of a node; nodes with children.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for text, t in vocabulary.items():
            if len(text) > 1 and t not in self.made:
                continue  # unreachable by merges
            node = 0
            for b in text:
                self.inner[node] = True
                if node * 256 + b not in self.child:
                    self.child[node * 256 + b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[node * 256 + b]
            self.token[node] = t
        self.max_states = max_states
        self._clear([])

    def _clear(self, kept: list[tuple]) -> None:
        """Only the two first states and the kept ones, in this order."""
        self.states: list[tuple] = [((0, -1, 0),), (), *kept]  # open node, last token before it, count there less the count now
        self.number = {key: k for k, key in enumerate(self.states)}
        size = max(1024, 2 * len(self.states))
        self.to, self.change = np.full((size, 256), -1, np.int32), np.zeros((size, 256), np.int8)
        self.to[OPEN] = OPEN

    def _drop_states(self, *live: np.ndarray) -> None:
        """Drops all states but those in live, whose numbers are changed in place."""
        used = np.unique(np.concatenate([[START, OPEN], *live]))
        self._clear([self.states[k] for k in used[2:].tolist()])
        for a in live:
            a[:] = np.searchsorted(used, a)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's right (0) or left (1) edge while it forms: symbol, rank of the merge that takes it in."""
        if token not in self.spines[side]:
            out, until = [(token, self.never)], token
            while until in self.made:
                a, b, k = self.made[until]
                until = a if side else b
                out.append((until, k))
            self.spines[side][token] = out
        return self.spines[side][token]

    def compatible(self, left: int, right: int) -> bool:
        """True if no merge across the border comes before the merges inside; of equal ranks the left one comes first."""
        if left < 0:
            return True
        key = (left, right)
        if key not in self.compatible_pairs:
            if len(self.compatible_pairs) > 500_000:
                self.compatible_pairs.clear()
            rank, never = self.rank, self.never
            self.compatible_pairs[key] = not any((m := rank.get((x, y), never)) < until_x and m <= until_y and m < never for x, until_x in self._spine(left, 0) for y, until_y in self._spine(right, 1))
        return self.compatible_pairs[key]

    def _grow(self, state: int, byte: int) -> None:
        """Make the transition of a state on a byte."""
        entries, child, token, inner = self.states[state], self.child, self.token, self.inner
        last, count, kept = -2, 0, []
        for node, before, less in entries:
            after = child.get(node * 256 + byte)
            if after is None:
                continue
            if last == -2 and token[after] >= 0 and self.compatible(before, token[after]):
                last, count = token[after], less + 1
            if inner[after]:
                kept.append((after, before, less))
        if last == -2:
            raise ValueError(f"no token ends at byte {byte}")
        key = (*((n, b, less - count) for n, b, less in kept), (0, last, 0))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.to):
                more = min(len(self.to), 32_768)
                self.to = np.concatenate([self.to, np.full((more, 256), -1, np.int32)])
                self.change = np.concatenate([self.change, np.zeros((more, 256), np.int8)])
        self.to[state, byte] = found
        self.change[state, byte] = count

    def _step(self, state: np.ndarray, letters: np.ndarray, *live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes; live has other states that must not be dropped."""
        at = (state << 8) | letters
        after = self.to.reshape(-1)[at]
        if (missing := after < 0).any():
            for k in np.unique(at[missing]).tolist():
                self._grow(k >> 8, k & 255)
            after = self.to.reshape(-1)[at]
        change = self.change.reshape(-1)[at]
        if len(self.states) > self.max_states:
            self._drop_states(after, *live)
        return after, change

    def changes(self, text: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The change of the number of tokens at each byte from the first mark of its chunk on, and the sum of those before it for each chunk; the first byte is marked."""
        n, chunks = len(text), -(-len(text) // CHUNK)
        letters, fresh = np.full(chunks * CHUNK, 10, np.int32), np.ones(chunks * CHUNK, bool)
        letters[:n], fresh[:n] = text, marks
        letters, fresh = (np.ascontiguousarray(x.reshape(chunks, CHUNK).T) for x in (letters, fresh))
        end, change = np.full(chunks, OPEN, np.int32), np.empty((CHUNK, chunks), np.int8)
        for k in range(CHUNK):
            end[fresh[k]] = START
            end, change[k] = self._step(end, letters[k])
        marked = fresh.any(0)
        head = np.zeros(chunks, np.int64)
        if not marked.all():
            self._compose(letters, np.flatnonzero(~marked), end, head)
        size = np.where(marked, fresh.argmax(0), 0)
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        state = end[order - 1]  # the first chunk begins with a mark and is not walked
        total = np.zeros(chunks, np.int64)
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(falling, -k, "left"))
            state = state[:live].copy()
            state, more = self._step(state, letters[k, order[:live]])
            total[:live] += more
        head[order] += total
        return np.ascontiguousarray(change.T).reshape(-1)[:n], head

    def _compose(self, letters: np.ndarray, chunks: np.ndarray, end: np.ndarray, head: np.ndarray) -> None:
        """Sets the end states and counts of chunks without a mark, which lie behind each other or behind a chunk with one."""
        first = np.flatnonzero(end[chunks - 1] != OPEN)
        known, ends, counts = np.zeros(0, np.int32), [], []
        new = np.unique(end[chunks[first] - 1])
        while len(new) and len(known) + len(new) <= MAP_STATES:
            known = np.concatenate([known, new])
            for i in range(len(new)):
                state, total = np.full(len(chunks), new[i], np.int32), np.zeros(len(chunks), np.int64)
                for k in range(CHUNK):
                    state, more = self._step(state, letters[k, chunks], known, end, new, *ends)
                    total += more
                ends.append(state)
                counts.append(total)
            new = np.setdiff1d(np.unique(np.concatenate(ends)), known).astype(np.int32)
        if len(new):
            for c in chunks.tolist():
                s, total = int(end[c - 1]), 0
                for b in letters[:, c].tolist():
                    if self.to[s, b] < 0:
                        self._grow(s, b)
                    total, s = total + int(self.change[s, b]), int(self.to[s, b])
                end[c], head[c] = s, total
                if len(self.states) > self.max_states:
                    self._drop_states(end)
            return
        sort = np.argsort(known)
        place = lambda states: sort[np.searchsorted(known, states, sorter=sort)]
        maps = np.stack([place(x) for x in ends], 1)
        begins = place(end[chunks[first] - 1])
        scan = maps.copy()
        scan[first] = maps[first, begins][:, None]
        shift = 1
        while shift < len(chunks):  # scan[i] becomes the map from the chain's beginning over chunk i
            scan[shift:] = np.take_along_axis(scan[shift:], scan[:-shift], 1)
            shift *= 2
        start = np.concatenate([[0], scan[:-1, 0]])
        start[first] = begins
        end[chunks], head[chunks] = known[scan[:, 0]], np.stack(counts, 1)[np.arange(len(chunks)), start]


class Transducer:
    """Both transducers of a tokenizer file; counts the tokens of texts."""

    def __init__(self, path: str, classes: np.ndarray | None = None, max_states: int = MAX_STATES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files are compiled")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        raw = lambda text: bytes(byte[c] for c in text)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.counter = Counter(vocabulary, [(raw(a), raw(b)) for a, b in pairs], max_states)
        self.classes = character_classes() if classes is None else classes
        self.to, self.begins = splitter()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of code points; ends are the places of the characters that end a text."""
        kind = self.classes[points]
        blank = kind == IN_SPACE
        symbol = kind.copy()
        last = np.flatnonzero(blank[:-1] & ~blank[1:])
        symbol[last] = np.where(points[last] == 32, LAST_SPACE, LAST_BLANK)
        marks = np.flatnonzero(points == 39)
        if len(marks):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            one, two = padded[marks + 1], padded[marks + 2]
            e, v, r, ell = 101, 118, 114, 108
            symbol[marks[np.isin(one, [115, 116, 109, 100])]] = SHORT  # s t m d
            symbol[marks[((one == r) & (two == e)) | ((one == v) & (two == e)) | ((one == ell) & (two == ell))]] = LONG
        symbol[ends] = END
        return symbol

    def begin_flags(self, symbol: np.ndarray) -> np.ndarray:
        """1 where a pre-token begins: chunk maps, their prefix scan, then all chunks from their true states."""
        n = len(symbol)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, END, np.uint8)
        padded[:n] = symbol
        by_step = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        flat_to, flat_begins = self.to.reshape(-1), self.begins.reshape(-1)
        maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (chunks, 8)).copy()
        for row in by_step:
            maps = flat_to[maps * np.uint8(9) + row[:, None]]
        shift = 1
        while shift < chunks:  # maps[i] becomes the map over chunks 0..i
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), 1)
            shift *= 2
        state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
        flags = np.empty((CHUNK, chunks), np.uint8)
        for k, row in enumerate(by_step):
            at = state * np.uint8(9) + row
            flags[k] = flat_begins[at]
            state = flat_to[at]
        return flags.T.reshape(-1)[:n]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out, parts, owner, held = np.zeros(len(texts), np.int64), [], [], 0
        for k, t in enumerate(texts):
            pieces = [t]
            for s in self.specials:
                pieces = [y for x in pieces for y in x.split(s)]
            out[k] = len(pieces) - 1
            for piece in (y for x in pieces for y in self.cut(x)):
                if held + len(piece) > 2 * PART:
                    np.add.at(out, owner, self._count(parts))
                    parts, owner, held = [], [], 0
                parts.append(piece)
                owner.append(k)
                held += len(piece)
        if parts:
            np.add.at(out, owner, self._count(parts))
        return out

    def cut(self, text: str) -> Iterator[str]:
        """text in parts of about PART characters, each but the first beginning with a pre-token; without a place for that it stays whole."""
        begin = 0
        while len(text) - begin > PART and (m := SURE_BEGIN.search(text, begin + PART)):
            yield text[begin : m.end()]
            begin = m.end()
        yield text[begin:]

    def _count(self, parts: list[str]) -> np.ndarray:
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        flags = self.begin_flags(self.symbols(points, ends)) == 1
        text = np.frombuffer(joined.encode(), np.uint8)
        heads = np.flatnonzero((text & 0xC0) != 0x80) if len(text) != len(points) else slice(None)
        marks = np.zeros(len(text), bool)
        marks[heads] = flags
        ends = ends if isinstance(heads, slice) else heads[ends]
        change, head = self.counter.changes(text, marks)
        change[ends] = 0  # line feeds between the parts
        sums = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        begins = np.concatenate([[0], ends[:-1] + 1])
        of_chunk = np.searchsorted(ends, np.arange(len(head)) * CHUNK)
        return sums[ends] - sums[begins] + np.bincount(of_chunk, head, len(parts)).astype(np.int64)


_compiled: dict[str, Transducer] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _compiled:
            _compiled[path] = Transducer(path)
        for batch in batches:
            texts, doc_ids = filled(column(batch, "text")), column(batch, "doc_id")
            sizes = byte_sizes(texts)
            for i, j in runs(sizes):
                n = _compiled[path].count(texts[i:j].to_pylist())
                yield pa.RecordBatch.from_arrays([doc_ids[i:j], pa.array(sizes[i:j]), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
