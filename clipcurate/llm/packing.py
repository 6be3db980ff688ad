"""Best-fit packing of token sequences by exact-complement hashing of lengths."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clipcurate.llm.common import materialize, release_memory, worker_tables

#: Characters of text that are tokenized at a time: what a Python worker holds of words and ids grows with this only.
PART_CHARS = 4 << 20
#: Entries of the tables of units and of words that recur.
MAX_UNITS, MAX_COMMON = 50_000, 250_000
#: Chunks at most that the pieces of a length are numbered in; their sizes go through one window.
MAX_CHUNKS = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts under a byte-level tokenizer, as little-endian unsigned 32-bit integers.

    Such a tokenizer splits a text before it merges: before a space between words, around a line break between words,
    and between letters and the punctuation after them. So texts are cut at single spaces into words; the distinct words
    of about PART_CHARS of text are tokenized once, unless they are known from the part before or among the words that
    recurred from part to part, and the ids of a text are gathered by its words' numbers. A space beside other white space, where the split depends on both, stays
    inside its word, and texts with such words are tokenized piece by piece.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take white space along or only stand alone are not known here")
        self.special = {t.content: np.array([i], "<u4") for i, t in added.items()}  # in a text they are tokens, and cut it
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level model writes as themselves
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words: dict[str, bytes] = {}  # by word, with the space before it understood
        self.older: dict[str, bytes] = {}  # those of the part before
        self.common: dict[str, bytes] = {}  # those that two parts in a row have held
        self.units: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merged(self, unit: str) -> bytes:
        """Ids of letters, with or without a space before them."""
        if unit.isascii():
            shown = unit.replace(" ", "\u0120")
        elif max(unit) < "\u0250":  # letters in any Unicode version: one piece for the model
            shown = unit.encode().decode("latin-1").translate(self.letters)
        else:
            return self.whole(unit)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def unit(self, unit: str) -> bytes:
        got = self.units.get(unit)
        if got is None:
            got = self.merged(unit) if unit.isalpha() else self.whole(unit)
            if len(self.units) > MAX_UNITS:
                self.units.clear()
            self.units[unit] = got
        return got

    def word(self, word: str) -> bytes:
        """Ids of a word after a space."""
        got = self.common.get(word) or self.words.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                self.words[word] = got = self.new_word(word)
            else:
                self.common[word] = got
        return got

    def new_word(self, word: str) -> bytes:
        if word.isalpha():
            return self.merged(" " + word)
        base = word.rstrip(".,!?;:")
        if base != word and base.isalpha():
            return self.word(base) + self.unit(word[len(base) :])
        first, *lines = word.split("\n")
        if not lines or first.split() != [first] or not first[-1].isalnum() and first[-1] not in ".,!?;:" or any(x.split() != [x] for x in lines):
            return self.whole(" " + word)
        return b"".join([self.word(first), *(self.unit("\n") + self.line(x) for x in lines)])

    def line(self, start: str) -> bytes:
        """Ids of a word that begins a line or a text."""
        base = start.rstrip(".,!?;:")
        if base != start and base.isalpha():
            return self.unit(base) + self.unit(start[len(base) :])
        return self.unit(start) if start else b""

    def parts(self, texts: list[str], begins: list[bool]) -> list[np.ndarray]:
        """Ids of each text; one that doesn't begin its document stands after a space."""
        self.older, self.words = self.words, {}
        if len(self.common) > MAX_COMMON:
            self.common = {}
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        odd = np.array([not w or w != w.strip() for w in words])
        slow = np.logical_or.reduceat(odd[code], ends[:-1]) if len(texts) else odd
        starts = [w.split(" ", 1)[0] for w in texts]
        slow |= np.array([begin and bool(s) and s[-1].isspace() for s, begin in zip(starts, begins, strict=True)])
        slow &= np.array([not (begin and not t) for t, begin in zip(texts, begins, strict=True)])  # an empty text is one empty word
        clean = np.zeros(len(words), bool)
        clean[code[np.repeat(~slow, np.diff(ends))]] = True
        recurs = self.common.get
        ids = [(recurs(w) or self.word(w)) if ok and w else b"" for w, ok in zip(words, clean.tolist(), strict=True)]
        at_begin = np.flatnonzero(np.array(begins) & ~slow)
        code[ends[:-1][at_begin]] = len(ids) + np.arange(len(at_begin))
        ids += [self.line(starts[k]) for k in at_begin.tolist()]
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids])
        n = size[code]
        last = np.cumsum(n)
        every = flat[np.repeat((np.cumsum(size) - size)[code] - last + n, n) + np.arange(last[-1] if len(last) else 0)]
        upto, out = np.concatenate([[0], last])[ends].tolist(), []
        for k, text in enumerate(texts):
            if slow[k]:
                pieces_ = pieces(text if begins[k] else " " + text)
                out.append(np.frombuffer(b"".join(map(self.whole, pieces_)), "<u4"))
                continue
            out.append(every[upto[k] : upto[k + 1]])
        return out

    def documents(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null counts as empty. A very long text goes through in several parts, and what stands
        between special tokens is a text of its own."""
        part, begins, of, after, size = [], [], [], [], 0

        def flush() -> list[tuple[bool, np.ndarray]]:
            ids = self.parts(part, begins) if part else []
            done = [(last, x if tail is None else np.concatenate([x, tail])) for last, x, tail in zip(of, ids, after, strict=True)]
            for x in (part, begins, of, after):
                x.clear()
            return done

        held: list[np.ndarray] = []  # of the text whose parts go on
        for text in texts:
            split = self.at_special.split(text or "") if self.at_special else [text or ""]
            pieces_ = []  # text, whether it begins one, the special token after it
            for k in range(0, len(split), 2):
                own = long_pieces(split[k], PART_CHARS)
                tail = self.special[split[k + 1]] if k + 1 < len(split) else None
                pieces_ += [(piece, j == 0, tail if j == len(own) - 1 else None) for j, piece in enumerate(own)]
            for k, (piece, start, tail) in enumerate(pieces_):
                if size + len(piece) > PART_CHARS:
                    for last, ids in flush():
                        held.append(ids)
                        if last:
                            yield np.concatenate(held) if len(held) > 1 else ids
                            held = []
                    size = 0
                part.append(piece)
                begins.append(start)
                after.append(tail)
                of.append(k == len(pieces_) - 1)
                size += len(piece)
        for last, ids in flush():
            held.append(ids)
            if last:
                yield np.concatenate(held) if len(held) > 1 else ids
                held = []

    def text(self, text: str) -> bytes:
        return next(self.documents(iter([text]))).tobytes()


def encoder(path: str) -> Encoder:
    return worker_tables(f"packing {path}", lambda: Encoder(path))


def pieces(text: str) -> list[str]:
    """The text cut before single spaces that stand between two characters that are no white space."""
    words = text.split(" ")
    out = [words[0]]
    for w in words[1:]:
        if w and out[-1] and not w[0].isspace() and not out[-1][-1].isspace():
            out.append(" " + w)
        else:
            out[-1] += " " + w
    return out


def long_pieces(text: str, most: int) -> list[str]:
    """The text in parts of about ``most`` characters, cut at single spaces (which are left out) between two characters that
    are no white space."""
    out, low = [], 0
    while len(text) - low > most:
        at = text.find(" ", low + most)
        while at > 0 and (at + 1 == len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[low:at])
        low = at + 1
    return [*out, text[low:]]


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a sequence's pieces: whole ones of ``size``, a shorter one first."""
    first = total % size or min(total, size)
    return [(0, first), *((s, size) for s in range(first, total, size))] if total else []


def tokenize(docs: DataFrame, doc_id: str, text: str, size: int, tokenizer: str | None = None, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of each document's tokens and the ``end`` id."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids
    final = np.array([end], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer or default_tokenizer())  # a path is looked up where the worker is
        release_memory()
        for batch in batches:
            rows = []
            for i, ids in enumerate(enc.documents(t.as_py() for t in batch.column("text"))):
                raw = np.concatenate([ids, final]).tobytes()
                rows += [(i, k, s, n, raw[4 * s : 4 * (s + n)] if keep_ids else b"", zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(raw) // 4, size))]
                if len(rows) > 20_000:
                    yield table(batch, rows)
                    rows = []
            if rows:
                yield table(batch, rows)

    def table(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, k, s, n, own, crc = zip(*rows, strict=True)
        out = {"doc_id": batch.column("doc_id").take(pa.array(at)), "piece": pa.array(k, pa.int32()), "start": pa.array(s, pa.int64()), "length": pa.array(n, pa.int32()), "ids_crc32": pa.array(crc, pa.int64())}
        return pa.record_batch(out | ({"ids": pa.array(own, pa.binary())} if keep_ids else {}))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def sums_index(lengths: list[int], size: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each sum below ``size``: the larger lengths a of the pairs (a, sum - a), and the largest lengths a of the triples
    (a, and a pair of sum - a), ascending. At most size^2 / 4 entries each, whatever the number of pieces."""
    own = [False] * (size + 1)
    for x in lengths:
        own[x] = True
    pairs: list[list[int]] = [[] for _ in range(size + 1)]
    triples: list[list[int]] = [[] for _ in range(size + 1)]
    for a in lengths:
        for b in range(1, min(a, size - a) + 1):
            if own[b]:
                pairs[a + b].append(a)
    for a in lengths:
        for rest in range(2, min(2 * a, size - a) + 1):
            if pairs[rest]:
                triples[a + rest].append(a)
    return pairs, triples


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences of which lengths, ``[(lengths, number)]``, for ``counts`` pieces of each length up to ``size``.

    From the longest down: a length's gap is looked up among single lengths, then sums of pairs, then of triples, and
    every combination that fills it exactly is used as often as all its lengths last. What no combination fits is packed
    best-fit: longest first, into the fullest sequence that has room. Works on counts, so its time depends on ``size`` only.
    """
    left = [0] * (size + 1)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    pairs, triples = sums_index(sorted(counts), size)

    def lasts(lengths: tuple[int, ...]) -> bool:
        return all(left[x] >= lengths.count(x) for x in lengths)

    def found(index: list[int], gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """The pair of the index with the largest first length that lasts beside those held. Pairs that no longer last at
        all are taken out for good: lengths only become fewer."""
        for at in range(len(index) - 1, -1, -1):
            pair = index[at], gap - index[at]
            if lasts((*held, *pair)):
                return pair
            if at == len(index) - 1 and not lasts(pair):
                index.pop()
        return None

    def complement(gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        if lasts((*held, gap)):
            return (gap,)
        if two := found(pairs[gap], gap, held):
            return two
        firsts = triples[gap]
        for at in range(len(firsts) - 1, -1, -1):
            a = firsts[at]
            if lasts((*held, a)) and (two := found(pairs[gap - a], gap - a, (*held, a))):
                return (a, *two)
            if at == len(firsts) - 1 and not (left[a] and pairs[gap - a]):
                firsts.pop()
        return None

    def use(lengths: tuple[int, ...]) -> None:
        n = min(left[x] // lengths.count(x) for x in lengths)
        for x in lengths:
            left[x] -= n
        out.append((lengths, n))

    if left[size]:
        use((size,))
    residual: dict[int, int] = {}
    for length in range(size - 1, 0, -1):
        while left[length]:
            rest = complement(size - length, (length,))
            if rest is None:
                residual[length] = left[length]
                left[length] = 0
            else:
                use((length, *rest))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # gap: what leaves it
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], n: int) -> None:
        if gap not in open_:
            gaps.insert(bisect_left(gaps, gap), gap)
            open_[gap] = []
        open_[gap].append((lengths, n))

    for length in sorted(residual, reverse=True):
        n = residual[length]
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):  # no room: open sequences, each filled with as many of these as it holds
                each = min(size // length, n)
                put(size - each * length, (length,) * each, n // each)
                n -= each * (n // each)
                continue
            gap = gaps[k]
            lengths, m = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(k)
            used = min(m, n)
            if m > used:
                put(gap, lengths, m - used)
            put(gap - length, (*lengths, length), used)
            n -= used
    return out + [x for rows in open_.values() for x in rows]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, tokenizer: str | None = None, end: int = 2, keep_ids: bool = False, chunk_rows: int = 256) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])`` of every piece of every document.

    A document is its token ids and the ``end`` id; only documents longer than ``size`` are cut. Of the pieces only the
    number of each length (``size`` integers) comes to the driver, where ``plan`` turns it into numbers of sequences of
    each make-up; the k-th piece of a length then takes the k-th place that the plan has for it. Pieces are numbered in
    chunks of about ``chunk_rows`` of one length, chosen by hash, so that a length that many pieces share is spread over tasks.

    Null texts count as empty: their only token is ``end``. Repeated rows are packed each for itself; null ids are kept.
    Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    found = tokenize(docs, doc_id, text, size, tokenizer, end, keep_ids)
    found = materialize(found.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most ``size`` rows
    places, base = [], 0
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    for lengths, n in plan(counts, size):
        offset = 0
        for x in lengths:
            places.append((x, taken[x], taken[x] + n, base, offset))
            taken[x] += n
            offset += x
        base += n
    own: dict[int, list] = {}
    for x, *place in places:
        own.setdefault(x, []).append(place)
    ranges = {x: np.array(sorted(rows), dtype=np.int64).T for x, rows in own.items()}  # bounded by ``size``, not by the pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, _, start, off = ranges[int(x)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = start[k] + rank[at] - first[k], off[k]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    salts = spark.createDataFrame([(x, min(MAX_CHUNKS, max(1, -(-n // chunk_rows)))) for x, n in counts.items()], "length int, chunks long")
    salted = found.join(F.broadcast(salts), "length").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(salted.groupBy("length", "chunk").count().select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before")), "starts")
    rank = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("rid")) - 1
    ranked = salted.withColumn("rank", rank).join(starts, ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    extra = ["ids"] if keep_ids else []
    ranked = ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *extra, F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(place, StructType([*ranked.schema.fields[:-1], StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: the token ids of each sequence of ``pack(..., keep_ids=True)``, little-endian, in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most a sequence's tokens
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.array_join(F.transform("p", lambda x: F.hex(x.ids)), "").alias("hex"), F.col("p.doc_id").alias("doc_ids")).select("sequence_id", F.unhex("hex").alias("ids"), "doc_ids")
