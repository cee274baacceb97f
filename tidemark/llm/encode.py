"""Tokenizing whole texts with the ``tokenizers`` library, one distinct piece at a time.

Byte-pair merges never cross a pre-token, so a text's ids are the ids of its pieces put side by side, if all cuts lie
between pre-tokens. Arrow kernels cut a batch and number its distinct pieces; workers keep a bounded memo of pieces and
hand only unseen ones to the library. Texts that can't be cut safely go to the library whole. The result equals that of
the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept for one tokenizer in one Python worker.
MEMO_PIECES = 400_000
#: Longer pieces are encoded but not kept.
MEMO_CHARS = 64
#: Pieces of one call of the library.
JOINED = 4_000
#: Texts are treated in batches of about so many bytes.
BATCH_BYTES = 4 << 20
SPACE, WORD_END = "\u0120", "</w>"
#: Where letters end and marks begin, either vocabulary's pattern ends a pre-token. These letters stay single letters when
#: normalised and lower-cased, whatever version of Unicode a library knows; others (such as U+0130) may not.
_EDGE = "([A-Za-zÀ-ÖØ-öø-ÿΑ-ΡΣ-ωА-я])([.,!?;:|&%$#*])"
_LINE = r"([^\s\pZ])\n([^\s\pZ])"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: In texts with these a cut could fall inside a special token, or at what only some libraries call white space.
_ODD = "<\\||[\\x00\\x1c-\\x1f]"
_MEMOS: dict[tuple[str, type], _Memo] = {}


def tokenizer(path: str):
    """The library's tokenizer of a file; no padding and no truncation."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


def batches(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about BATCH_BYTES and where they start; a longer text is a slice of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), "i8"))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


class _Memo:
    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.known: dict = {}

    @classmethod
    def of(cls, path: str):
        """One memo for each file and Python worker."""
        if (path, cls) not in _MEMOS:
            _MEMOS[path, cls] = cls(path)
        return _MEMOS[path, cls]

    def _flags(self, marks: Iterator[str]) -> np.ndarray:
        out = np.zeros(self.library.get_vocab_size() + 1, bool)
        out[list(marks)] = True
        return out

    def _whole(self, texts: list[str]) -> list:
        return [self._value(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _values(self, pieces: list[str]) -> list:
        """What the distinct pieces of a batch stand for."""
        known = self.known
        new = [w for w in pieces if w not in known]
        found = self._ask(new) if new else {}
        if len(known) + len(found) > MEMO_PIECES:  # what is met often is in this batch too
            known = self.known = {w: known[w] for w in pieces if w in known}
        if len(known) + len(found) <= MEMO_PIECES:
            known.update(item for item in found.items() if len(item[0]) <= MEMO_CHARS)
            return [known[w] if w in known else found[w] for w in pieces]
        return [found[w] if w in found else known[w] for w in pieces]

    def _cut_up(self, texts) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str], np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        cut = self._cut(pc.if_else(odd, "", texts))
        numbers = cut.flatten().dictionary_encode()
        offsets = np.asarray(cut.offsets, "i8")
        return texts, np.array(odd), np.asarray(numbers.indices), numbers.dictionary.to_pylist(), offsets - offsets[0]


class IdMemo(_Memo):
    """Ids of a byte-level tokenizer, whose pre-tokens carry the space before them."""

    def __init__(self, path: str):
        super().__init__(path)
        self.opens = self._flags(i for token, i in self.library.get_vocab().items() if token[0] == SPACE)

    @staticmethod
    def _value(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    @staticmethod
    def _cut(texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring_regex(pc.replace_substring_regex(texts, _EDGE, "\\1\0\\2"), _LINE, "\\1\0\n\0\\2")
        return pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")

    def _ask(self, pieces: list[str]) -> dict[str, bytes]:
        """One call for many words: each has one space, at its start, so each token that opens with one opens a word."""
        words, rest = [], []
        for w in pieces:
            (words if w[:1] == " " and not w[1:2].isspace() and w != " " else rest).append(w)
        out = dict(zip(rest, self._whole(rest), strict=True))
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            ids = np.array(self.library.encode("".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(some):
                raise AssertionError(f"{len(some)} words gave {len(cuts)} opening tokens")
            raw, at = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            out.update(zip(some, [raw[a:b] for a, b in zip(at, at[1:])], strict=True))
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) and, for each text and the end, where they start; a null text has none."""
        texts, odd, numbers, pieces, offsets = self._cut_up(texts)
        # a cut before a space holds only if no space follows it
        unsafe = np.array([w[:1] == " " and (len(w) == 1 or w[1].isspace()) for w in pieces], bool)
        if unsafe.any():
            hit = np.concatenate([[0], np.cumsum(unsafe[numbers])])[offsets]
            odd |= hit[1:] > hit[:-1]
        values = self._values(pieces)
        sizes = np.fromiter(map(len, values), "i8", len(values)) // 4
        firsts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(values), "<u4")
        took = sizes[numbers]
        ends = np.cumsum(took)
        ids = flat[np.repeat(firsts[numbers] - ends + took, took) + np.arange(ends[-1] if len(ends) else 0)]
        starts = np.concatenate([[0], ends])[offsets]
        if odd.any():
            rows = np.flatnonzero(odd)
            whole = dict(zip(rows.tolist(), self._whole(texts.take(pa.array(rows)).to_pylist()), strict=True))
            each = [np.frombuffer(whole[i], "<u4") if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(starts, starts[1:]))]
            ids, starts = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, starts


class CountMemo(_Memo):
    """Numbers of ids of a tokenizer that drops white space between words."""

    def __init__(self, path: str):
        super().__init__(path)
        self.closes = self._flags(i for token, i in self.library.get_vocab().items() if token.endswith(WORD_END))

    @staticmethod
    def _value(ids: list[int]) -> int:
        return len(ids)

    @staticmethod
    def _cut(texts: pa.Array) -> pa.Array:
        return pc.utf8_split_whitespace(pc.replace_substring_regex(texts, _EDGE, "\\1 \\2"))

    def _ask(self, pieces: list[str]) -> dict[str, int]:
        """One call for many pieces of letters alone: each is one pre-token, and so has one closing token, its last."""
        words, rest = [], []
        for w in pieces:
            (words if _LETTERS.fullmatch(w) else rest).append(w)
        out = dict(zip(rest, self._whole(rest), strict=True))
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.closes[ids])
            if len(cuts) != len(some):
                raise AssertionError(f"{len(some)} words gave {len(cuts)} closing tokens")
            out.update(zip(some, np.diff(cuts, prepend=-1).tolist(), strict=True))
        return out

    def count(self, texts) -> np.ndarray:
        """Ids of each text; 0 for a null text."""
        texts, odd, numbers, pieces, offsets = self._cut_up(texts)
        values = np.array(self._values(pieces), "i8")
        total = np.concatenate([[0], np.cumsum(values[numbers] if len(values) else [])]).astype("i8")[offsets]
        out = total[1:] - total[:-1]
        rows = np.flatnonzero(odd)
        out[rows] = self._whole(texts.take(pa.array(rows)).to_pylist())
        return out


def folds_text(path: str) -> bool:
    """Whether a tokenizer's normaliser makes blank runs one space and letters lower-case, so that such texts count alike."""
    with open(path) as f:
        made = json.load(f).get("normalizer") or {}
    steps = made.get("normalizers", [made])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return blanks in steps and {"type": "Lowercase"} in steps


def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """What counts the ids of each text: by word ends if the vocabulary has them, else by byte-level pre-tokens."""
    if (memo := CountMemo.of(path)).closes.any():
        return memo.count
    ids = IdMemo.of(path)
    return lambda texts: np.diff(ids.encode(texts)[1])
