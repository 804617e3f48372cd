"""SentencePiece encoding, decoding and exact N-best segmentation.

The lattice of a text has a node before and after every character of its normalised form and an
edge for every vocabulary piece; a character that no piece covers alone has an edge of its own, with
the penalty of unknown pieces, which is spelled as byte pieces where the model has them. A forward
Viterbi pass gives every node the best score from the beginning. These are exact heuristics for the
backward A* search: hypotheses grow from the end of the text, the one with the best sum of its own
score and its node's forward score is taken next, and it reaches the beginning in the order of the
paths' scores.

No piece holds some pairs of characters (a letter before the mark of a space, for one). Every path
goes through the node between such a pair, so the lattice falls apart there into segments: the
search runs once for each distinct segment, and the N best paths of a text are found by the same
search over its segments, of which only the N - 1 with the least loss to their second path can
depart from their best. Long texts are taken in parts of about PART characters, cut between segments.

Scores are the model's piece scores (of a BPE model: less the rank of the merge). ``encode`` is the
library's own encoding; ``decode`` turns ids back to text.

Defined results: a null or empty text has no pieces, one empty path and score 0; a text with fewer
than N paths has that many; of paths with equal scores any may come first, always the same one; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_sizes, column, documents, filled, mix64, runs
from .textkit import BASE, RangeHash
from .tokens import tokenizer_path

QUERY = "op1_nbest_pieces"
NBEST = 3
UNKNOWN_PENALTY = 10.0
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"
STORE_SEGMENTS, STORE_IDS = 900_000, 16_000_000
PART = 1 << 20
#: Characters of a segment up to which the edges are listed when the forward pass meets them; the search looks up those of longer ones.
LISTED = 4096

RESULT = "doc_id long, n_bytes long, n_pieces long, score double, path_scores array<double>, second_pieces long, ids_crc32 long, restored boolean"


class Lattice:
    """The pieces of a model file, and searches over the lattices of texts."""

    def __init__(self, path: str, nbest: int = NBEST):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.nbest = nbest
        plain = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k))]
        self.pieces = {sp.id_to_piece(k): (sp.get_score(k), k) for k in plain}
        self.longest = max(map(len, self.pieces))
        # Every beginning of a piece; () where it is no piece itself.
        self.prefixes = {p[:k]: () for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY
        #: Sums of whole scores are exact in any order; others are compared to six places.
        self.whole = all(s.is_integer() for s, _ in self.pieces.values())
        self.byte_ids = {int(sp.id_to_piece(k)[1:-1], 16): k for k in range(sp.get_piece_size()) if sp.is_byte(k)}
        self.raw = [bytes([int(sp.id_to_piece(k)[1:-1], 16)]) if sp.is_byte(k) else b"" if sp.is_control(k) else sp.id_to_piece(k).encode() for k in range(sp.get_piece_size())]
        self.raw[sp.unk_id()] = " \N{DOUBLE QUESTION MARK} ".encode()
        # held[a * 256 + b]: some piece has the characters a and b in a row.
        self.held = np.zeros(1 << 16, bool)
        self.splits_at_space = True
        for piece in self.pieces:
            for a, b in zip(piece, piece[1:], strict=False):
                if ord(a) < 256 and ord(b) < 256:
                    self.held[ord(a) << 8 | ord(b)] = True
                self.splits_at_space &= b != SPACE or a == SPACE
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        #: Of every segment: its best path's ids (in a row with all others'), and scores and sizes of its nbest best paths.
        self.at, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.scores, self.sizes = np.zeros((0, self.nbest)), np.zeros((0, self.nbest), np.int32)

    def forward(self, text: str) -> tuple[array, list[list[tuple[int, tuple[float, int]]]] | None]:
        """The best score from the beginning to every node, and the edges that end at every node, by their begins (None: text is longer than LISTED)."""
        n, get, nothing = len(text), self.prefixes.get, (self.unknown, -1)
        best = array("d", [-np.inf]) * (n + 1)
        best[0] = 0.0
        ends = [[] for _ in range(n + 1)] if n <= LISTED else None
        for i in range(n):
            own, j = best[i], i + 1
            found = get(text[i:j])
            if not found:  # no piece is this character alone
                if own + self.unknown > best[j]:
                    best[j] = own + self.unknown
                if ends:
                    ends[j].append((i, nothing))
            while found is not None:
                if found:
                    if own + found[0] > best[j]:
                        best[j] = own + found[0]
                    if ends:
                        ends[j].append((i, found))
                j += 1
                if j > n:
                    break
                found = get(text[i:j])
        return best, ends

    def edges(self, text: str, node: int) -> Iterator[tuple[int, tuple[float, int]]]:
        """The edges that end at a node, the last to begin first: begin, (score, id; -1: unknown)."""
        if text[node - 1] not in self.pieces:
            yield node - 1, (self.unknown, -1)
        for i in range(node - 1, max(-1, node - 1 - self.longest), -1):
            if found := self.pieces.get(text[i:node]):
                yield i, found

    def search(self, text: str, nbest: int) -> list[tuple[float, tuple[int, ...]]]:
        """The nbest best paths as (score, ids)."""
        if not text:
            return [(0.0, ())]
        best, ends = self.forward(text)
        exact, first = self.whole, -best[-1]
        agenda, count, found = [(first if exact else round(first, 6), len(text), 0, 0.0, None)], 0, []
        while agenda and len(found) < nbest:
            _, node, _, own, rest = agenda.pop(0)
            if not node:
                ids = []
                while rest is not None:
                    i, k, rest = rest
                    ids.extend(self.spell(text[i]) if k < 0 else (k,))
                found.append((own, tuple(ids)))
                continue
            # Edges of a node differ in their begins and expansions in their counts, so no comparison goes beyond these.
            count += 1
            for i, (s, k) in ends[node] if ends else self.edges(text, node):
                score = own + s
                key = -score - best[i]
                agenda.append((key if exact else round(key, 6), i, count, score, (i, k, rest)))
            agenda.sort()
            del agenda[nbest - len(found) :]
        return found

    def spell(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.library.unk_id()]

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes in a row, marks of spaces as spaces, without the one put in front."""
        raw = b"".join(b"".join(map(self.raw.__getitem__, ids[k : k + PART])) for k in range(0, len(ids), PART))
        text = raw.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def _learn(self, hashes: list[int], segments: list[str]) -> None:
        new, none = [self.search(s, self.nbest) for s in segments], (-np.inf, ())
        self.slot.update(zip(hashes, range(len(self.at), len(self.at) + len(new)), strict=True))
        filled_up = [p + [none] * (self.nbest - len(p)) for p in new]
        size = np.array([[len(ids) for _, ids in p] for p in filled_up], np.int32).reshape(-1, self.nbest)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size[:, 0], dtype=np.int64) - size[:, 0]])
        self.ids = np.concatenate([self.ids, np.array([k for p in new for k in p[0][1]], np.uint32)])
        self.scores = np.concatenate([self.scores, np.array([[s for s, _ in p] for p in filled_up]).reshape(-1, self.nbest)])
        self.sizes = np.concatenate([self.sizes, size])

    def _combine(self, slots: np.ndarray, best: float) -> list[tuple[float, int]]:
        """Scores of the nbest best paths of segments in a row, with the change in pieces: A* over the segments that can depart."""
        n = self.nbest - 1
        if not n:
            return [(best, 0)]
        loss = self.scores[slots, 0] - self.scores[slots, 1]
        part = np.argpartition(loss, n - 1)[:n] if len(loss) > n else np.arange(len(loss))
        able = slots[sorted(k for k in part.tolist() if np.isfinite(loss[k]))]
        open_paths = [[(s, m) for s, m in zip(a, b, strict=True) if np.isfinite(s)] for a, b in zip(self.scores[able].tolist(), self.sizes[able].tolist(), strict=True)]
        # The exact heuristic of what is left is that all of it is at its best: a loss of 0.
        agenda, count, found = [(0.0, 0, 0, 0)], 0, []
        while agenda and len(found) < self.nbest:
            lost, _, k, change = heapq.heappop(agenda)
            if k == len(open_paths):
                found.append((best - lost, change))
                continue
            first = open_paths[k][0]
            for s, m in open_paths[k]:
                count += 1
                heapq.heappush(agenda, (lost + first[0] - s, count, k + 1, change + m - first[1]))
        return found

    def segment(self, texts: list[str]) -> list[tuple[np.ndarray, list[tuple[float, int]]]]:
        """For each text the ids of its best path, and score and pieces of the nbest best."""
        normal = [self.library.normalize(t) if t else "" for t in texts]
        if all(len(t) <= PART for t in normal):
            return self._segment(normal)
        out = []
        for text in normal:
            ids, paths = [], [(0.0, 0)]
            for part in self.parts(text):
                ((own, found),) = self._segment([part])
                ids.append(own)
                paths = sorted(((a + s, m + n) for a, m in paths for s, n in found), key=lambda x: -x[0])[: self.nbest]
            out.append((np.concatenate(ids), paths))
        return out

    def parts(self, text: str) -> Iterator[str]:
        """text in parts of about PART characters that no piece reaches across; a longer run without such a place is one part."""
        begin = 0
        while len(text) - begin > PART:
            end = begin + PART
            while end < len(text) and not self.apart(text[end - 1], text[end]):
                end += 1
            yield text[begin:end]
            begin = end
        yield text[begin:]

    def apart(self, a: str, b: str) -> bool:
        """Whether no piece holds the characters a and b in a row, as far as the table of pairs tells."""
        return (ord(a) < 256 and ord(b) < 256 and not self.held[ord(a) << 8 | ord(b)]) or (self.splits_at_space and b == SPACE and a != SPACE)

    def _segment(self, normal: list[str]) -> list[tuple[np.ndarray, list[tuple[float, int]]]]:
        """The same for normalised texts."""
        if len(self.at) > STORE_SEGMENTS or len(self.ids) > STORE_IDS:
            self._clear()
        joined = "\0".join(normal) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in normal]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        a, b = points[:-1], points[1:]
        cut = (a < 256) & (b < 256) & ~self.held[(a << 8 | b) & 0xFFFF]
        if self.splits_at_space:
            cut |= (b == ord(SPACE)) & (a != ord(SPACE))
        flags = np.concatenate([[True], cut])
        flags[begins] = flags[ends] = True
        begin = np.flatnonzero(flags)
        end = np.append(begin[1:], len(points))
        is_text = np.ones(len(points), bool)
        is_text[ends] = False
        begin, end = begin[keep := is_text[begin]], end[keep]
        at = np.searchsorted(begin, np.append(begins, len(points)))
        seen, first, which = np.unique(RangeHash(mix64(points.astype(np.uint64)), BASE)(begin, end), return_index=True, return_inverse=True)
        hashes = seen.tolist()
        slots = np.fromiter((self.slot.get(h, -1) for h in hashes), np.int64, len(hashes))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            slots[missing] = np.arange(len(self.at), len(self.at) + len(missing))
            self._learn([hashes[k] for k in missing.tolist()], [joined[begin[k] : end[k]] for k in first[missing].tolist()])
        mine = slots[which]
        size = self.sizes[mine, 0].astype(np.int64)
        ids = self.ids[np.repeat(self.at[mine] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        id_at = np.concatenate([[0], np.cumsum(size)])[at]
        out = []
        for k in range(len(normal)):
            own = ids[id_at[k] : id_at[k + 1]]
            paths = self._combine(mine[at[k] : at[k + 1]], float(self.scores[mine[at[k] : at[k + 1]], 0].sum()))
            out.append((own, [(s, len(own) + change) for s, change in paths]))
        return out


_loaded: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, nbest: int) -> Lattice:
    """One for each worker process and model."""
    if (path, nbest) not in _loaded:
        _loaded[path, nbest] = Lattice(path, nbest)
    return _loaded[path, nbest]


def segment(docs: DataFrame, path: str, nbest: int = NBEST) -> DataFrame:
    """RESULT of every row of docs (doc_id, text): the best path's pieces, score and ids, the scores of the nbest best, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, nbest)
        for batch in batches:
            texts, doc_ids = filled(column(batch, "text")), column(batch, "doc_id")
            sizes = byte_sizes(texts)
            for i, j in runs(sizes):
                own = texts[i:j].to_pylist()
                found = model.segment(own)
                columns = [
                    pa.array([len(ids) for ids, _ in found], pa.int64()), pa.array([p[0][0] for _, p in found], pa.float64()), pa.array([[s for s, _ in p] for _, p in found], pa.list_(pa.float64())),
                    pa.array([p[1][1] if len(p) > 1 else None for _, p in found], pa.int64()), pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids, _ in found], pa.int64()), pa.array([model.decode(ids) == t for (ids, _), t in zip(found, own, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([doc_ids[i:j], pa.array(sizes[i:j]), *columns], [x.split(" ")[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the library's own encoding of whole texts (null: no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, NBEST)
        for batch in batches:
            texts = filled(column(batch, "text"))
            for i, j in runs(byte_sizes(texts)):
                ids = model.library.encode(texts[i:j].to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[i:j], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of coded (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, NBEST)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
