"""Alignment of two tokenizers by the byte offsets where tokens of both end.

A text is encoded by a byte-level BPE (A, of a blank and the text) and by a piece BPE (B,
which puts that blank itself).  Offsets where an A and a B token both end cut the tokens
into groups; the two tokens that end there are a link.  A text whose joined token bytes
differ from blank and text has no tokens.

Equal texts are encoded once: documents are shuffled by their full text and counted, each
distinct text is tokenised and aligned, and its links count as often as the text occurs.
Measures go back to documents by the SHA-256 of the text.

Neither tokenizer merges over a single blank between two printing characters (checked
against the vocabulary for B, by the pre-tokenizer's rule for A), so both end a token in
front of it.  The stretches between such blanks are therefore aligned by themselves, many
in one call, and remembered within a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.llm.common import broadcast_object, checkpointed, stored

MARK = "▁"
#: Stretches remembered in a task, and their characters in all; both are cleared beyond.
MEMO, MEMO_CHARS = 400_000, 32_000_000
#: Links worked on together, and characters tokenised together (a longer text is a step of its own).
STEP_LINKS, STEP_CHARS = 1_000_000, 2_000_000
#: Pairs that a task counts before it hands on what it has.
HELD_PAIRS = 4_000_000
#: Bytes of the table of pair counts up to which executors get it whole; beyond, it is joined.
TABLE_BYTES, PAIR_BYTES = 64_000_000, 16
#: A stretch of more characters goes to the library that the file of A is written for.
LONG_STRETCH = 100_000
# The splitting rule of byte-level BPE files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank between two printing characters.
_CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")


@dataclass(frozen=True)
class TokenizerPair:
    a: str
    b: bytes


def load_pair(a_path: str, b_path: str) -> TokenizerPair:
    """The files of both tokenizers, read once on the driver (bounded by their vocabularies)."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return TokenizerPair(f.read(), g.read())


def _stand_ins() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where printable, else the next free one from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of a text, and the bytes of each id."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        j = json.loads(spec)
        model, added = j["model"], {x["content"]: x["id"] for x in j.get("added_tokens", [])}
        byte = _stand_ins()
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        self.out = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in vocab.items():
            self.out[i] = bytes(map(byte.__getitem__, t))
        for t, i in added.items():
            self.out[i] = t.encode()
        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = True
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        pre = j.get("pre_tokenizer") or {}
        #: Ids in the order of merges and the usual splitting: the ids are ranks, and the faster library gives the same.
        ranked = all(x < y for x, y in zip(merged, merged[1:])) and len(merged) + 256 == len(vocab) and not j.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuts_at_blank = plain
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={self.out[i]: i for i in vocab.values()}, special_tokens={}) if ranked and plain else None

    def encode(self, text: str, long: bool = False) -> np.ndarray:
        if self.fast is None or long:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class Pieces:
    """Tokenizer B, which puts a blank in front of a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.lib.get_piece_size())
        pieces = [self.lib.id_to_piece(i) for i in ids]
        self.out = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in zip(ids, pieces)]
        self.cuts_at_blank = not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text), np.int64)


def _numbers(n: int) -> np.ndarray:
    """Rows of ``id,`` for n ids and then of ``id`` with a closing mark 0x01, padded with zeros."""
    width = len(str(n)) + 1
    rows = np.array([f"{i}{end}" for end in ",\x01" for i in range(n)], f"S{width}")
    return rows.view(np.uint8).reshape(-1, width)


class Aligner:
    """Aligned stretches of text, remembered by their number: counts, link codes and groups."""

    def __init__(self, pair: TokenizerPair):
        self.a, self.b = ByteLevel(pair.a), Pieces(pair.b)
        self.size_a, self.size_b = np.array(list(map(len, self.a.out))), np.array(list(map(len, self.b.out)))
        self.n_b = len(self.b.out)
        self.cuts = self.a.cuts_at_blank and self.b.cuts_at_blank
        na, nb = _numbers(len(self.a.out)), _numbers(self.n_b)
        self.digits = np.zeros((len(na) + len(nb), max(na.shape[1], nb.shape[1])), np.uint8)
        self.digits[: len(na), : na.shape[1]] = na
        self.digits[len(na) :, : nb.shape[1]] = nb
        self.digits[len(self.a.out) : len(na)][self.digits[len(self.a.out) : len(na)] == 1] = ord("|")
        self.digits[len(na) + self.n_b :][self.digits[len(na) + self.n_b :] == 1] = ord(";")
        self.written = (self.digits != 0).sum(1)
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}  # parts between blanks; -1: not between printing characters
        self.other: dict[str, int] = {}  # stretches of texts that hold such parts
        self.n_a, self.n_b_of, self.fits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.first, self.codes, self.groups = np.zeros(1, np.int64), np.zeros(0, np.int64), []
        self.chars = 0

    def _block(self, units: list[str]) -> list[tuple]:
        """(n_a, n_b, link counts, codes, groups, fits) for units that go on at single blanks; halves are tried where the whole doesn't fit."""
        text = " ".join(units)
        want = (" " + text).encode()
        a, b = self.a.encode(" " + text, len(text) > LONG_STRETCH and len(units) == 1), self.b.encode(text)
        sizes = np.array([len(u.encode()) for u in units]) + 1
        stops = np.cumsum(sizes)
        fits = b"".join(map(self.a.out.__getitem__, a.tolist())) == want and b"".join(map(self.b.out.__getitem__, b.tolist())) == want
        if fits:
            end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            mark = np.zeros(len(want) + 1, np.int8)
            mark[end_a] += 1
            mark[end_b] += 1
            fits = bool((mark[stops] == 2).all())
        if not fits:
            if len(units) == 1:
                return [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [b""], np.zeros(1, bool))]
            half = len(units) // 2
            return self._block(units[:half]) + self._block(units[half:])
        close_a, close_b = mark[end_a] == 2, mark[end_b] == 2
        codes = a[close_a] * self.n_b + b[close_b]
        n = len(units)
        own_a, own_b = np.searchsorted(stops, end_a), np.searchsorted(stops, end_b)
        links = np.bincount(own_a[close_a], minlength=n)
        group = np.concatenate([2 * (np.cumsum(close_a) - close_a), 2 * (np.cumsum(close_b) - close_b) + 1])
        order = np.argsort(group, kind="stable")
        rows = np.concatenate([a + close_a * len(self.a.out), 2 * len(self.a.out) + b + close_b * self.n_b])[order]
        letters = self.digits[rows]
        flat = letters[letters != 0].tobytes()
        ends = np.cumsum(np.bincount(np.concatenate([own_a, own_b])[order], weights=self.written[rows], minlength=n)).astype(np.int64).tolist()
        return [(np.bincount(own_a, minlength=n), np.bincount(own_b, minlength=n), links, codes, [flat[s : e - 1] for s, e in zip([0, *ends], ends)], np.ones(n, bool))]

    def _learn(self, units: list[str], joined: bool) -> range:
        """Numbers of new units.  ``joined``: they begin and end with printing characters, so many go in one call."""
        found, lo, size, at = [], 0, 0, len(self.groups)
        for k, u in enumerate(units):
            size += len(u) + 1
            if size > STEP_CHARS or not joined or k == len(units) - 1:
                found += self._block(units[lo : k + 1])
                lo, size = k + 1, 0
        self.chars += sum(map(len, units))
        if found:
            na, nb, links, codes, groups, fits = zip(*found)
            self.n_a, self.n_b_of, self.fits = np.concatenate([self.n_a, *na]), np.concatenate([self.n_b_of, *nb]), np.concatenate([self.fits, *fits])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(links))])
            self.codes = np.concatenate([self.codes, *codes])
            for g in groups:
                self.groups += g
        return range(at, len(self.groups))

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The stretches of each text, by number."""
        if len(self.groups) > MEMO or self.chars > MEMO_CHARS:
            self._clear()
        parts = [t.split(" ") if self.cuts else [""] for t in texts]
        new = list(dict.fromkeys(p for ps in parts for p in ps if p not in self.memo))
        between = [p for p in new if p and (p[0].isalnum() or "!" <= p[0] <= "~") and (p[-1].isalnum() or "!" <= p[-1] <= "~")]
        self.memo.update(dict.fromkeys(new, -1))
        self.memo.update(zip(between, self._learn(between, True)))
        out = [list(map(self.memo.__getitem__, ps)) for ps in parts]
        rough = {k: _CUT.split(texts[k]) if self.cuts else [texts[k]] for k, ns in enumerate(out) if min(ns) < 0}
        new = list(dict.fromkeys(u for us in rough.values() for u in us if u not in self.other))
        self.other.update(zip(new, self._learn(new, False)))
        for k, us in rough.items():
            out[k] = list(map(self.other.__getitem__, us))
        return out

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """(n_a, n_b, n_links, distinct codes of links in order, how often each, groups) of each text that isn't empty."""
        numbers = self.numbers(texts)
        lo = 0
        while lo < len(texts):
            hi, links = lo, 0
            while hi < len(texts) and (hi == lo or links < STEP_LINKS):
                links += 2 * len(numbers[hi])
                hi += 1
            sizes = np.array([len(x) for x in numbers[lo:hi]])
            flat = np.array([i for x in numbers[lo:hi] for i in x], np.int64)
            starts = np.cumsum(sizes) - sizes
            fits = np.minimum.reduceat(self.fits[flat], starts)
            n_a, n_b = np.add.reduceat(self.n_a[flat], starts) * fits, np.add.reduceat(self.n_b_of[flat], starts) * fits
            count = (self.first[flat + 1] - self.first[flat]) * np.repeat(fits, sizes)
            n_links = np.add.reduceat(count, starts)
            codes = self.codes[np.repeat(self.first[flat] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            text = np.repeat(np.arange(hi - lo), n_links)
            span = np.int64(len(self.a.out)) * self.n_b
            keys, times = np.unique(text * span + codes, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(hi - lo + 1) * span)
            keys %= span
            for k in range(hi - lo):
                groups = b";".join(map(self.groups.__getitem__, numbers[lo + k])) if fits[k] else b""
                yield n_a[k], n_b[k], n_links[k], keys[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]], groups
            lo = hi


#: Columns of a distinct text besides its groups.
_FIELDS = [T.StructField("key", T.BinaryType()), T.StructField("rows", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_links")), T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]


def _key(text):
    return F.unhex(F.sha2(text, 256))


def encode_distinct(docs: DataFrame, pair: TokenizerPair, text_col: str = "text", groups: str | None = "sha256") -> DataFrame:
    """One written row per distinct text that isn't null or empty, tokenised and aligned once.

    key (SHA-256 of the text), rows (how many documents have it), n_a, n_b, n_links, codes
    (distinct links as a * size of B + b, in order), times (how often each occurs), and
    groups: as ``sha256`` in hex, as ``text``, or none.  Groups and links are as many.
    """
    texts = docs.select(docs[text_col].alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("rows"))
    src = texts.select(_key("text").alias("key"), "rows", "text")
    held = broadcast_object(docs.sparkSession, pair)
    fields = _FIELDS + ([T.StructField("groups", T.StringType())] if groups else [])

    def write(g: bytes) -> str:
        return "" if not g else hashlib.sha256(g).hexdigest() if groups == "sha256" else g.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(held())
            sizes, lo = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo : lo + 500]), STEP_CHARS)))
                part, lo = batch.slice(lo, hi - lo), hi
                na, nb, nl, codes, times, gs = zip(*((*x[:5], write(x[5]) if groups else "") for x in aligner.align(part.column(2).to_pylist())))
                ends = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(codes), pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times), pa.int32()))]
                cols = [part.column(0), part.column(1), *(pa.array(np.array(x), pa.int64()) for x in (na, nb, nl)), *lists, *([pa.array(gs, pa.string())] if groups else [])]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return stored(src.mapInArrow(run, T.StructType(fields)))


def pair_counts(distinct: DataFrame) -> DataFrame:
    """(code, n): how many links in all documents hold a pair; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_codes, held_n, size = [], [], 0

        def merged():
            codes, at = np.unique(np.concatenate(held_codes), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, np.concatenate(held_n))
            return codes, n

        for batch in batches:
            lists = batch.column(1)
            rows = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(lists.offsets)))
            held_codes.append(np.asarray(lists.flatten()))
            held_n.append(np.asarray(batch.column(2).flatten()).astype(np.int64) * rows)
            size += len(rows)
            if size > HELD_PAIRS:
                codes, n = merged()
                if len(codes) > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])
                    codes, n = codes[:0], n[:0]
                held_codes, held_n, size = [codes], [n], len(codes)
        if size:
            codes, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    return distinct.select("rows", "codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _looked_up(distinct: DataFrame, codes: np.ndarray, n: np.ndarray, n_b: int) -> DataFrame:
    """Distinct texts with their measures, by a table of all pairs in every executor."""
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, codes % n_b, n)
    held = broadcast_object(distinct.sparkSession, (codes, n, n == most[codes % n_b]))
    kept = [f for f in distinct.schema if f.name not in ("rows", "codes", "times")]
    names = [*(f.name for f in kept), "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = held()
        for batch in batches:
            lists, times = batch.column(0), np.asarray(batch.column(1).flatten()).astype(np.int64)
            ends = np.asarray(lists.offsets)
            at = np.searchsorted(codes, np.asarray(lists.flatten()))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends - ends[0]]) for x in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(x, pa.int64()) for x in sums)], names)

    measures = [T.StructField(c, T.LongType()) for c in names[-2:]]
    return distinct.select("codes", "times", *(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, *measures]))


def _joined(distinct: DataFrame, counts: DataFrame, n_b: int) -> DataFrame:
    """The same by joins, for a table of any size."""
    most = counts.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("n").alias("most"))
    table = counts.join(most, F.col("code") % n_b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    links = distinct.select("key", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("key", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    sums = links.join(table, "code").groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return distinct.drop("rows", "codes", "times").join(sums, "key", "left")


def align(docs: DataFrame, pair: TokenizerPair, id_col: str = "doc_id", text_col: str = "text", groups: str | None = "sha256", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups as encode_distinct() writes them.

    n_best counts the links whose pair is the commonest of its B id in all documents (ties
    included), count_sum sums the corpus-wide counts of its links' pairs.  Null and empty
    texts, and texts that either tokenizer doesn't give back byte for byte, have zeros and
    empty groups, and add nothing to the counts.  Repeated rows count, and come out, as
    often as they occur; ids may be null; other columns are not read.  The table of pair
    counts is sent to executors if it has ``table_bytes`` or fewer, else joined.
    """
    distinct = encode_distinct(docs, pair, text_col, groups)
    counts = checkpointed(pair_counts(distinct))
    n_b = len(Pieces(pair.b).out)
    if counts.count() * PAIR_BYTES <= table_bytes:
        t = counts.toArrow()
        found = _looked_up(distinct, t["code"].to_numpy(), t["n"].to_numpy(), n_b)
    else:
        found = _joined(distinct, counts, n_b)
    src = docs.select(docs[id_col].alias("id"), _key(docs[text_col]).alias("key"))
    measures = {"n_a": "n_a", "n_b": "n_b", "n_groups": "n_links", "n_links": "n_links", "n_best": "n_best", "count_sum": "count_sum"}
    out = [F.coalesce(c, F.lit(0).cast("long")).alias(name) for name, c in measures.items()]
    return src.join(found, "key", "left").select("id", *out, *([F.coalesce("groups", F.lit("")).alias("groups")] if groups else []))
