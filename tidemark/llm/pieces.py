"""N-best segmentations into SentencePiece pieces, and back to text.

A text's lattice has an edge for each piece of the vocabulary that stands at a place, weighted by the model's score of the
piece, and for characters that are no piece one of their bytes' pieces. Segmentations are ranked by the sum of scores. For
a unigram model these are its own n best; a byte-pair model's scores are its merges' ranks, negated, so the best sum need
not be the library's greedy merge, but every segmentation decodes to the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encode import batches

MARK = "\u2581"
#: Units kept in one Python worker, and alternatives of units.
MEMO_UNITS, MEMO_LISTS = 300_000, 20_000
_MODELS: dict[str, Lattice] = {}


class Lattice:
    """The pieces of a model, and segmentations of units: runs of marks with what follows up to the next, or parts of it.

    Units are cut only where no piece reaches over, so a text's lattice is that of its units end to end.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        usual = [i for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
        self.pieces = {p.id_to_piece(i): (p.get_score(i), i) for i in usual}
        if any(MARK in x.lstrip(MARK) for x in self.pieces):
            raise ValueError("a piece holds a mark inside a word; such models aren't supported")
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = p.unk_id()
        self.has_bytes = all(p.is_byte(i) for i in self.bytes)
        self.longest = max(map(len, self.pieces))
        #: What pieces begin with: score and ids of those that are pieces themselves, None for others.
        self.begun = {x[:k]: None for x in self.pieces for k in range(1, len(x))} | {x: (s, (i,)) for x, (s, i) in self.pieces.items()}
        scores = [s for s, _ in self.pieces.values() if s > -1e8]
        #: What a byte (or an unknown character) costs: more than any usual piece.
        self.rare = min(scores) - 10.0
        self.apart = not any("\n" in x for x in self.pieces)
        #: Marks that no piece holds right after a letter: text may be cut before them there.
        self.ends = "".join(c for c in ".,!?;:|&%$#*" if not any(re.search(rf"[^\W\d_]{re.escape(c)}", x) for x in self.pieces))
        self.known: dict[str, tuple[float, float, bytes]] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @classmethod
    def of(cls, path: str) -> Lattice:
        """One lattice for each file and Python worker."""
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def edges(self, u: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place from 1 on, the edges that end there: where they begin, their score and their ids."""
        get, longest = self.pieces.get, self.longest
        out: list[list[tuple[int, float, tuple[int, ...]]]] = []
        for j in range(1, len(u) + 1):
            here = [(i, s[0], (s[1],)) for i in range(max(0, j - longest), j) if (s := get(u[i:j])) is not None]
            if not here or here[-1][0] != j - 1:
                s, ids = self._rare(u[j - 1])
                here.append((j - 1, s, ids))
            out.append(here)
        return out

    def _rare(self, c: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of a character that is no piece."""
        raw = c.encode("utf-8", "surrogatepass")
        ids = tuple(self.bytes[x] for x in raw) if self.has_bytes else (self.unknown,)
        return self.rare * len(ids), ids

    def best(self, u: str) -> tuple[float, float, bytes]:
        """The best sum of a unit, how far the second best is behind (inf if there is none), and the best one's ids."""
        n, get = len(u), self.begun.get
        first, second, via = [0.0, *[-np.inf] * n], [-np.inf] * (n + 1), [None] * (n + 1)
        for i in range(n):
            f, g = first[i], second[i]
            j = i
            while j < n:
                j += 1
                edge = get(u[i:j], False)
                longer = edge is not False
                if not edge:
                    if j > i + 1:
                        if longer:
                            continue
                        break
                    edge = self._rare(u[i])
                w = edge[0]
                s = f + w
                if s > first[j]:
                    second[j], first[j], via[j] = first[j], s, (i, edge[1])
                elif s > second[j]:
                    second[j] = s
                if g + w > second[j]:
                    second[j] = g + w
                if not longer:
                    break
        steps = []
        j = n
        while j:
            j, ids = via[j]
            steps.append(ids)
        return first[-1], first[-1] - second[-1], np.array([x for ids in reversed(steps) for x in ids], "<u4").tobytes()

    def n_best(self, u: str, n: int) -> list[tuple[float, bytes]]:
        """The n best sums of a unit and their ids, by A* from its end: forward Viterbi sums say exactly what is to come.

        Ways to what lies before a place don't depend on how it was reached from the end, so only the n best of those
        count: a place is passed n times at most, however many ways have equal sums.
        """
        edges = self.edges(u)
        ahead = [0.0]
        for here in edges:
            ahead.append(max(ahead[e[0]] + e[1] for e in here))
        queue = [(-ahead[-1], 0, len(u), 0.0, None)]
        passed = [0] * (len(u) + 1)
        out, order = [], 0
        while queue and len(out) < n:
            _, _, j, done, path = heapq.heappop(queue)
            if passed[j] == n:
                continue
            passed[j] += 1
            if not j:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((done, np.array(ids, "<u4").tobytes()))
                continue
            for e in reversed(edges[j - 1]):  # of equal sums, that with the longer first step back comes later
                order += 1
                s = done + e[1]
                heapq.heappush(queue, (-(s + ahead[e[0]]), order, e[0], s, (e[2], path)))
        return out

    def units(self, text: str) -> list[str]:
        """The units of a text; none of an empty one."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        parts = re.split(f"(?<=[^{MARK}])(?={MARK})|(?<=[A-Za-z])(?=[{self.ends}])" if self.ends else f"(?<=[^{MARK}])(?={MARK})", marked)
        return [x for p in parts for x in (re.split("(\n)", p) if self.apart else [p]) if x]

    def segment(self, texts: pa.Array, n: int) -> list[list[tuple[float, bytes]]]:
        """For each text its n best sums (all, if fewer) and ids, best first."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring(texts, "\0")
        plain = pc.replace_substring_regex(pc.if_else(odd, "", texts), "^(?s:(.))", " \\1")
        plain = pc.replace_substring(plain, " ", MARK)
        cut = pc.replace_substring_regex(plain, f"([^{MARK}])({MARK})", "\\1\0\\2")
        cut = pc.replace_substring_regex(cut, f"(\\pL)([{self.ends}])", "\\1\0\\2") if self.ends else cut
        cut = pc.replace_substring(cut, "\n", "\0\n\0") if self.apart else cut
        lists = pc.split_pattern(cut, "\0")
        numbers = lists.flatten().dictionary_encode()
        pieces, at = numbers.dictionary.to_pylist(), np.asarray(lists.offsets, "i8")
        values = self._values(pieces)
        behind = np.array([v[1] for v in values])
        index = np.asarray(numbers.indices)
        out = []
        for i, is_odd in enumerate(odd.to_pylist()):
            if is_odd:
                names = self.units(texts[i].as_py())
                some = self._values(names)
                out.append(self._ranked(names, some, np.array([v[1] for v in some]), n))
            else:
                rows = index[at[i] - at[0] : at[i + 1] - at[0]]
                picked = rows.tolist()
                out.append(self._ranked([pieces[r] for r in picked] if n > 1 else [], [values[r] for r in picked], behind[rows], n))
        return out

    def _values(self, units: list[str]) -> list[tuple[float, float, bytes]]:
        known = self.known
        if len(known) + len(units) > MEMO_UNITS:
            known = self.known = {u: known[u] for u in units if u in known}
        for u in units:
            if u not in known:
                known[u] = self.best(u) if u else (0.0, np.inf, b"")
        return [known[u] for u in units]

    def _list(self, u: str, n: int) -> list[tuple[float, bytes]]:
        if len(self.lists) > MEMO_LISTS:
            self.lists.clear()
        if (u, n) not in self.lists:
            best, _, ids = self.known.get(u) or self.best(u)  # of ways with equal sums, best()'s comes first
            self.lists[u, n] = [(best, ids), *(x for x in self.n_best(u, n) if x[1] != ids)][:n]
        return self.lists[u, n]

    def _ranked(self, names: list[str], values: list[tuple[float, float, bytes]], behind: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """The n best of a text. Only the n - 1 units whose second best is least behind can change in one of them: a
        change elsewhere would cost more than each of n - 1 single changes."""
        total, parts = sum([v[0] for v in values]), [v[2] for v in values]
        chosen = [int(i) for i in np.argsort(behind, kind="stable")[: n - 1] if behind[i] < np.inf] if n > 1 else []
        ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for i in sorted(chosen):
            options = self._list(names[i], n)
            grown = [(c + options[0][0] - s, (*w, (i, r)) if r else w) for c, w in ways for r, (s, _) in enumerate(options)]
            ways = sorted(grown)[:n]
        out = []
        for cost, changes in ways:
            some = parts.copy() if changes else parts
            for i, r in changes:
                some[i] = self._list(names[i], n)[r][1]
            out.append((total - cost, b"".join(some)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation."""
        return self.library.decode(ids.tolist())


def n_best_segments(docs: DataFrame, model_path: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rank (from 1), score, n_pieces and ids (little-endian uint32) of the n best segmentations of whole texts.

    A text with fewer segmentations has fewer rows. A null or empty text has one: no pieces and a score of 0. Among equal
    scores, changes of earlier units come later. Repeated rows give rows each; null ids stay; other columns are ignored.
    Nothing is shuffled; memory follows a batch of texts or the longest one.
    """

    def segment(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of(model_path)
        for b in parts:
            for at, texts in batches(b.column(1)):
                made = lattice.segment(texts, n)
                sizes = np.array([len(m) for m in made])
                owner = pa.array(np.repeat(np.arange(at, at + len(texts)), sizes))
                rank = np.concatenate([np.arange(1, s + 1) for s in sizes]).astype("i4")
                ids = [x[1] for m in made for x in m]
                yield pa.record_batch([b.column(0).take(owner), pa.array(rank), pa.array([x[0] for m in made for x in m], pa.float64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "rank", "score", "n_pieces", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(segment, "doc_id long, rank int, score double, n_pieces long, ids binary")


def decode_segments(segments: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """segments with the text of each in `text`; null ids give null."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        lattice = Lattice.of(model_path)
        return pd.Series([None if x is None else lattice.decode(np.frombuffer(x, "<u4")) for x in ids], dtype=object)

    return segments.withColumn("text", decode(F.col(ids_col)))
