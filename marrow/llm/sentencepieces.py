"""SentencePiece encoding by a streaming Viterbi search, and exact decoding.

The vocabulary (pieces and scores) is read from a public model file; the search is our
own.  A text is escaped (one blank in front, blanks as U+2581) and read from left to
right.  best[j] is the largest sum of scores of a segmentation of the first j characters;
only positions from the last commitment to the furthest piece end are held.  Ids are
committed whenever all surviving paths meet at one boundary: at a position beyond which
no open piece reaches, or, when none comes for a while, at the boundary that a trace of
all live ends has in common.  A character without a piece is spelt in byte pieces.

Where no piece holds a blank mark after another character, a blank always is such a
meeting point, so the spans between blanks are searched apart, many short ones in lockstep, and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marrow.llm.common import broadcast_object, slices, HashIndex

MARK = "▁"
#: Spans remembered in a worker, each of at most SPAN characters.
MEMO, SPAN = 600_000, 48
#: Texts split into words at a time.
TEXTS = 250
#: Score of a byte piece below the lowest score of the vocabulary.
BYTE_PENALTY = 10.0
#: Stretches between meeting points: from a line break, or from a run of blanks.
_SPANS = re.compile(r"\n[^ \n]*| *[^ \n]+| +")


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[str, ...]  # n normal, b byte, x never produced


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a .model file, read once on the driver (bounded by the vocabulary)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    return Vocabulary(tuple(p.id_to_piece(i) for i in range(n)), tuple(p.get_score(i) for i in range(n)), tuple("b" if p.is_byte(i) else "x" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "n" for i in range(n)))


_NEVER = float("-inf")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _fold(chars: np.ndarray) -> np.ndarray:
    """A hash of each row of characters that grows by one character at a time."""
    h = np.zeros(len(chars), np.uint64)
    for j in range(chars.shape[1]):
        h = (h ^ chars[:, j]) * _PRIME
    return h



class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        normal = {p: (s, i) for i, (p, s, k) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds)) if k == "n" and p}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds)) if k == "b"}
        self.byte_score = min([s for s, _ in normal.values()], default=0.0) - BYTE_PENALTY
        self.longest = max(map(len, normal), default=1)
        #: Every prefix of a piece; a piece itself has its score and id, a mere prefix has ().
        self.prefixes: dict[str, tuple] = {p[:k]: () for p in normal for k in range(1, len(p))} | normal
        self.cuts_at_blank = not any(MARK in p.lstrip(MARK) for p in normal) and not any("\n" in p for p in normal)
        self.out = [bytes([int(p[3:5], 16)]) if k == "b" else p.replace(MARK, " ").encode() if k == "n" else b"" for p, k in zip(vocabulary.pieces, vocabulary.kinds)]
        keys = list(self.prefixes)
        self.index = HashIndex(np.array([_fold(np.array([[ord(c) for c in k]], np.uint64))[0] for k in keys], np.uint64))
        self.leaf_score = np.array([self.prefixes[k][0] if self.prefixes[k] else _NEVER for k in keys])
        self.leaf_id = np.array([self.prefixes[k][1] if self.prefixes[k] else -1 for k in keys], np.int32)
        self.memo: dict[str, bytes] = {}

    def stream(self, chars: str, window: list[int] | None = None) -> Iterator[list[tuple[int, int]]]:
        """Committed paths of escaped characters, in order, as (start, id or -1 for bytes).

        ``window`` gets the most positions held.
        """
        n, get, longest, trace = len(chars), self.prefixes.get, self.longest, 4 * self.longest
        best, back = [0.0] + [_NEVER] * (2 * longest), [(0, 0)] * (2 * longest + 1)
        base = reach = 0
        for i in range(n):
            if i == reach and i > base:  # no open piece goes on: every path passes here
                yield self._path(back, base, i)
                del best[: i - base], back[: i - base]
                base = i
            elif i - base >= trace and (i - base) % longest == 0:
                c = self._common(back, base, range(i, reach + 1), best)
                if c > base:
                    yield self._path(back, base, c)
                    del best[: c - base], back[: c - base]
                    base = c
            if len(best) <= i - base + longest:
                best += [_NEVER] * (2 * longest)
                back += [(0, 0)] * (2 * longest)
            here = best[i - base]
            single = False
            for j in range(i + 1, min(n, i + longest) + 1):
                leaf = get(chars[i:j])
                if leaf is None:
                    break
                if leaf:
                    s = here + leaf[0]
                    if s > best[j - base]:
                        best[j - base], back[j - base] = s, (i, leaf[1])
                    if j == i + 1:
                        single = True
                    if j > reach:
                        reach = j
            if not single:  # spell it
                s = here + self.byte_score * len(chars[i].encode("utf-8", "surrogatepass"))
                if s > best[i + 1 - base]:
                    best[i + 1 - base], back[i + 1 - base] = s, (i, -1)
                reach = max(reach, i + 1)
            if window is not None:
                window[0] = max(window[0], reach - base)
        if n > base:
            yield self._path(back, base, n)

    @staticmethod
    def _path(back: list, base: int, end: int) -> list[tuple[int, int]]:
        out = []
        while end > base:
            step = back[end - base]
            out.append(step)
            end = step[0]
        return out[::-1]

    @staticmethod
    def _common(back: list, base: int, ends: range, best: list) -> int:
        """The last boundary that the paths to all live ends share."""
        live = {j for j in ends if best[j - base] > _NEVER}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(back[far - base][0] if far > base else base)
        return live.pop()

    def span(self, chars: str) -> bytes:
        """Ids of escaped characters as little-endian 32-bit integers."""
        ids: list[int] = []
        for path in self.stream(chars):
            for start, i in path:
                if i >= 0:
                    ids.append(i)
                else:
                    ids += [self.byte_ids[b] for b in chars[start].encode("utf-8", "surrogatepass")]
        return np.array(ids, "<i4").tobytes()

    def lockstep(self, spans: list[str]) -> list[bytes]:
        """span() of many short stretches at once: the same search, character by character over all of one length."""
        out = [b""] * len(spans)
        by: dict[int, list[int]] = {}
        for k, x in enumerate(spans):
            by.setdefault(len(x), []).append(k)
        for n, own in by.items():
            for lo in range(0, len(own), 20_000):
                part = own[lo : lo + 20_000]
                for k, ids in zip(part, self._lockstep([spans[k] for k in part], n)):
                    out[k] = ids
        return out

    def _lockstep(self, spans: list[str], n: int) -> list[bytes]:
        m = len(spans)
        chars = np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n).astype(np.uint64)
        best, start, piece = np.full((m, n + 1), _NEVER), np.zeros((m, n + 1), np.int16), np.full((m, n + 1), -1, np.int32)
        best[:, 0] = 0
        for i in range(n):
            rows, h = np.arange(m), np.zeros(m, np.uint64)
            single = np.zeros(m, bool)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = (h ^ chars[rows, j - 1]) * _PRIME
                at = self.index.find(h)
                alive = at >= 0
                rows, h, at = rows[alive], h[alive], at[alive]
                if not len(rows):
                    break
                s = best[rows, i] + self.leaf_score[at]
                won = s > best[rows, j]
                r = rows[won]
                best[r, j], start[r, j], piece[r, j] = s[won], i, self.leaf_id[at[won]]
                if j == i + 1:
                    single[rows[self.leaf_id[at] >= 0]] = True
            rows = np.flatnonzero(~single)
            if len(rows):
                c = chars[rows, i]
                s = best[rows, i] + self.byte_score * (1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000))
                won = s > best[rows, i + 1]
                r = rows[won]
                best[r, i + 1], start[r, i + 1], piece[r, i + 1] = s[won], i, -1
        ids, at, rows, used = np.zeros((m, n), "<i4"), np.full(m, n), np.arange(m), np.zeros(m, np.int64)
        spelt = np.zeros(m, bool)
        while len(rows):
            got = piece[rows, at[rows]]
            spelt[rows[got < 0]] = True
            used[rows] += 1
            ids[rows, n - used[rows]] = got
            at[rows] = start[rows, at[rows]]
            rows = rows[(at[rows] > 0) & ~spelt[rows]]
        return [self.span(x) if odd else ids[k, n - u :].tobytes() for k, (x, odd, u) in enumerate(zip(spans, spelt, used.tolist()))]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of stretches without blanks; each follows a blank unless it starts with a line break."""
        memo = self.memo
        new = list(words.difference(memo))
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(words)
        chars = [w if w[:1] == "\n" else MARK + w.replace(" ", MARK) for w in new]
        short = [k for k, x in enumerate(chars) if len(x) <= SPAN]
        memo.update(zip([new[k] for k in short], self.lockstep([chars[k] for k in short])))
        memo.update((w, self.span(x)) for w, x in zip(new, chars) if len(x) > SPAN)

    def _split(self, text: str) -> tuple[str, list[str]] | None:
        """Stretches between meeting points, with what stands in front; None where blanks don't part paths."""
        if not self.cuts_at_blank or MARK in text or text[0] == " ":
            return None
        spaced = text.replace("\n", " \n")
        if "  " in spaced:  # runs of blanks have pieces of their own
            found = _SPANS.findall(text)
            return (MARK if text[0] == "\n" else "", [found[0], *(x if x[:1] == "\n" else x[1:] for x in found[1:])])
        words = spaced.split(" ")
        return (MARK, words[1:]) if text[0] == "\n" else ("", words)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts.  A U+2581 of a text itself is spelt in bytes, so that decoding is exact."""
        parts = [self._split(t) if t else None for t in texts]
        out, lo, size, words = [], 0, 0, set()
        for k, p in enumerate(parts):  # learn the words of some texts together
            if p:
                size += len(p[1])
                words.update(p[1])
            if size > 300_000 or k == len(parts) - 1:
                self._learn(words)
                out += [self._one(t, q) for t, q in zip(texts[lo : k + 1], parts[lo : k + 1])]
                lo, size, words = k + 1, 0, set()
        return out

    def _one(self, text: str, part: tuple[str, list[str]] | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if part is not None:
            return np.frombuffer((self.span(part[0]) if part[0] else b"") + b"".join(map(self.memo.__getitem__, part[1])), "<i4")
        own = np.array([self.byte_ids[b] for b in MARK.encode()], "<i4").tobytes()
        return np.frombuffer(own.join([self.span(p.replace(" ", MARK)) for p in (" " + text).split(MARK)]), "<i4")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids from encode(), without the blank put in front."""
        return b"".join(map(self.out.__getitem__, ids))[1:]


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id, ids (array<int>), n_ids, exact (decoding gives the text back), and the decoded text if asked.

    A null text gives null ids and a null decoded text, and counts as exact; an empty text
    gives no ids.  Texts of any length stream through a bounded window.  Repeated rows give
    repeated results; other columns are not read.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fields = [T.StructField("id", src.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("exact", T.BooleanType())]
    fields += [T.StructField("decoded", T.StringType())] if keep_text else []
    held = broadcast_object(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(held())
        for part in slices(batches, TEXTS):
            sizes, chunks, same, texts = [0], [], [], []
            nulls = []
            given = part.column(1).to_pylist()
            for t, ids in zip(given, e.encode_all([t or "" for t in given])):
                back = e.decode(ids.tolist())
                nulls.append(t is None)
                same.append(t is None or back == t.encode("utf-8"))
                texts.append(None if t is None else back)
                chunks.append(ids)
                sizes.append(sizes[-1] + len(ids))
            arrays = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(chunks) if chunks else np.zeros(0, "<i4"), pa.int32()), mask=pa.array(nulls, pa.bool_()))
            cols = [part.column(0), arrays, pa.array(np.diff(sizes), pa.int64()), pa.array(same, pa.bool_())]
            cols += [pa.array(texts, pa.binary()).cast(pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))
