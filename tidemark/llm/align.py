"""Alignment of two tokenizers over the same bytes.

Both tokenizers encode a text with one space before it; a token's end is the offset of the byte after its last. Only the tokens and their ends are made
in Python. Everything after that is higher-order functions over arrays: ``array_intersect`` of the two arrays of ends gives the cuts; a text of marks made of them, one
byte for each byte of the document, tells in one step whether an offset is a cut; ``sequence`` filtered by those marks gives the place of each group's last token, ``zip_with`` (a
``transform`` of two arrays) the groups and links, and ``aggregate`` binds what several lambdas read, so that it is worked out once for a row. Each step takes one pass over the
tokens, however long the document.

A link is a pair of tokens, one of each side, that end at the same byte. The links of all documents are counted by pair of ids (partial counts before the
exchange). A document's links meet those counts by a broadcast join while there are at most BROADCAST_PAIRS different pairs, which is counted first, and
by a sort-merge join beyond.

Tokens are made by the public libraries, chunk by chunk: a chunk starts at each space or line feed that follows a character other than white space, where either
tokenizer always ends a token (no piece of the second goes on over a line feed; that is checked), so the chunks' tokens are the text's tokens. A worker keeps the tokens of chunks that it has met.

Defined results: a null or empty text has no tokens, nor has one whose tokens' bytes, joined, differ from the space and the text (as where a text holds
U+2581 itself); its counts are 0 and its ``groups_text`` is empty. Repeated rows count as often as they are there; no row is dropped; null ids stay;
other columns pass through, but for those that have the names of the output, which it replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, free_name, small_arrow_batches, staged

#: Where either tokenizer ends a token.
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
#: A worker keeps chunks of so many characters, each counted as EACH more; about 100 MB.
CACHE, EACH = 20_000_000, 40
#: Characters of new chunks that are encoded as one text.
RUN = 1 << 15
#: Bytes from one cut to the next up to which their marks are looked up.
SHORT = 16
#: Different pairs of ids up to which their counts are broadcast: 24 bytes each, some 64 MB as a hash table.
BROADCAST_PAIRS = 1_000_000
TOKENS = ("a_ids", "a_ends", "b_ids", "b_ends")
ALIGNED = (*TOKENS, "a_last", "b_last", "links")


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable bytes by themselves, the rest by letters from U+0100 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Known:
    """The tokens of chunks that a worker has met: a number for each chunk, and both sides' ids by number. No ids: a side's bytes differ from the chunk's.

    Of too many chunks the half that was met last stays.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.met, self.size, self.now = np.zeros(0, np.int64), 0, 0

    def add(self, chunks: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``sides``: the ids of all the chunks in a row, and how many each has."""
        first = len(self.number)
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        for k, (ids, lengths) in enumerate(sides):
            self.flat[k] = np.concatenate([self.flat[k], ids])
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(lengths)])
        self.met = np.concatenate([self.met, np.full(len(chunks), self.now)])
        self.size += sum(map(len, chunks)) + EACH * len(chunks)

    def forget(self) -> None:
        if self.size > CACHE:
            kept = np.flatnonzero(self.met >= np.median(self.met) + (self.met.min() == self.met.max()))
            names = np.array(list(self.number), object)[kept].tolist()
            sides = [self.ids(kept, k) for k in range(2)]
            met, now = self.met[kept], self.now
            self.__init__()
            self.now = now
            self.add(names, sides)
            self.met = met

    def ids(self, numbers: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in a row, and how many each has."""
        start, end = self.starts[side][numbers], self.starts[side][numbers + 1]
        lengths = end - start
        shift = np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
        return self.flat[side][shift + np.arange(len(shift))], lengths


class Pair:
    """The two tokenizers, and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(b"\n" in x and x != b"\n" for x in self.bytes_b):
            raise ValueError("a piece of the second tokenizer goes on over a line feed")
        self.space_b = self.b.piece_to_id("▁")
        self.lengths_a, self.lengths_b = (np.array(list(map(len, of)), np.int64) for of in (self.bytes_a, self.bytes_b))
        self.words, self.chunks = Known(), Known()

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ids(self, side: int, texts: list[str]) -> list[list[int]]:
        """A side's ids of texts that start with a space or a line feed."""
        if side == 0:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # the second tokenizer puts a space before what it gets: it stands for that of a text, and goes where a text has none
        out = self.b.encode([c[1:] if c[0] == " " else c for c in texts], num_threads=1)
        for k, c in enumerate(texts):
            if c[0] != " ":
                # without that space in front, the bytes will not be those wanted
                out[k] = out[k][1:] if out[k][0] == self.space_b else [self.space_b, *out[k]]
            elif c == " ":  # what stands before an empty text is left out
                out[k] = [self.space_b]
        return out

    def _each(self, side: int, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one by one; none for those whose bytes differ."""
        of = (self.bytes_a, self.bytes_b)[side]
        found = [ids if b"".join(map(of.__getitem__, ids)) == c.encode() else [] for c, ids in zip(chunks, self._ids(side, chunks))]
        return np.fromiter(chain.from_iterable(found), np.int32), np.array(list(map(len, found)), np.int64)

    def _together(self, side: int, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that may stand in one text, as none of them ends with white space: they are encoded as texts of about RUN characters."""
        of, lengths = ((self.bytes_a, self.lengths_a), (self.bytes_b, self.lengths_b))[side]
        ids, counts, first = [], [], 0
        sizes = np.cumsum([len(c) for c in chunks])
        while first < len(chunks):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + RUN)))
            own = chunks[first:last]
            text = "".join(own)
            (found,) = self._ids(side, [text])
            got = np.array(found, np.int32)
            ends = np.concatenate([[0], np.cumsum(lengths[got])])
            wanted = np.cumsum([len(c.encode()) for c in own])
            at = np.searchsorted(ends, wanted)
            if at[-1] < len(ends) and (ends[at] == wanted).all() and b"".join(map(of.__getitem__, found)) == text.encode():
                ids.append(got)
                counts.append(np.diff(at, prepend=0))
            else:
                one, n = self._each(side, own)
                ids.append(one)
                counts.append(n)
            first = last
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, known: Known, chunks: set[str], plain: bool) -> None:
        """Adds chunks; ``plain`` ones are given without the space before them, and do not end with white space."""
        known.now += 1
        known.forget()
        new = list(chunks.difference(known.number))
        if new:
            own = [c if c[0] == "\n" else " " + c for c in new] if plain else new
            known.add(new, [(self._together if plain else self._each)(side, own) for side in range(2)])

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of whole texts in a row, and how many each text has; none where a text has no tokens."""
        parted = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        # spaces and line feeds part the chunks of a text unless white space stands before one of them
        plain = set().union(*parted)
        edged = {w for w in plain if not w or w[-1].isspace()}
        odd = [not edged.isdisjoint(own) or own[:1] != [] and own[0][0] == "\n" for own in parted]
        parted = [BOUNDARY.split(" " + t) if o else own for t, o, own in zip(texts, odd, parted)]
        self.learn(self.words, plain - edged, True)
        self.learn(self.chunks, {c for own, o in zip(parted, odd) if o for c in own}, False)
        sides: list[list] = [[None] * len(texts), [None] * len(texts)]
        for known, which in ((self.words, False), (self.chunks, True)):
            rows = [r for r, o in enumerate(odd) if o == which]
            sizes = np.array([len(parted[r]) for r in rows], np.int64)
            numbers = np.fromiter(map(known.number.__getitem__, chain.from_iterable(parted[r] for r in rows)), np.int64, int(sizes.sum()))
            known.met[numbers] = known.now
            of = np.repeat(np.arange(len(rows)), sizes)
            found = [known.ids(numbers, side) for side in range(2)]
            differs = np.zeros(len(rows), bool)
            differs[of[(found[0][1] == 0) | (found[1][1] == 0)]] = True
            for side, (ids, lengths) in enumerate(found):
                ends = np.cumsum(np.bincount(of, lengths, len(rows)).astype(np.int64))
                for k, (r, own) in enumerate(zip(rows, np.split(ids, ends[:-1]) if rows else [])):
                    sides[side][r] = own[:0] if differs[k] else own
        return [(np.concatenate([np.zeros(0, np.int32), *own]), np.array(list(map(len, own)), np.int64)) for own in sides]


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """One for each Python worker."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def _ends(sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of token sizes that begin anew with each text."""
    total = np.cumsum(sizes)
    before = np.concatenate([[0], total])[np.cumsum(lengths) - lengths]
    return total - np.repeat(before, lengths)


def tokenise(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``docs`` with both sides' ids and ends in place of the text. The paths name files that every executor has."""
    small_arrow_batches(docs.sparkSession)
    taken = {text_col.lower(), *ALIGNED}
    fields = [f for f in docs.schema.fields if f.name.lower() not in taken]
    schema = T.StructType(fields + [T.StructField(n, T.ArrayType(T.IntegerType(), False), False) for n in TOKENS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(path_a, path_b)
        for batch in batches:
            names = batch.schema.names
            sides = own.encode(batch.column(names.index(text_col)).to_pylist())
            made = []
            for (ids, counts), sizes in zip(sides, (own.lengths_a, own.lengths_b)):
                made += [_lists(ids, counts), _lists(_ends(sizes[ids], counts), counts)]
            keep = [i for i, n in enumerate(names) if n.lower() not in taken]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + made, schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however many lambdas read it."""
    return F.aggregate(F.array().cast("array<boolean>"), value, lambda kept, _: kept, body)


def _before(values: Column, first: int) -> Column:
    """For each value the one before it; ``first`` for the first."""
    return F.concat(F.array(F.lit(first)), F.slice(values, 1, F.size(values) - 1))


def _marks(cuts: Column) -> Column:
    """A byte for each byte up to the last cut: 1 where there is a cut. The marks of short ways are looked up, as padding goes byte by byte."""
    short = F.array(*(F.lit("0" * k + "1") for k in range(SHORT)))
    return F.array_join(F.zip_with(cuts, _before(cuts, 0), lambda end, start: F.coalesce(F.get(short, end - start - 1), F.lpad(F.lit("1"), end - start, F.lit("0")))), "").cast("binary")


def _places(ends: Column, marks: Column) -> Column:
    """Places of the tokens that end at a cut."""
    return _let(ends, lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.substring(marks, F.get(own, i), F.lit(1)) == F.lit(b"1")))


def _links(a_ids: Column, b_ids: Column, a_last: Column, b_last: Column) -> Column:
    return F.zip_with(a_last, b_last, lambda i, j: F.shiftleft(F.get(a_ids, i).cast("long"), 32) + F.get(b_ids, j))


def align(tokens: DataFrame) -> DataFrame:
    """What tokenise() gives, with ``a_last`` and ``b_last`` (the places of each group's last tokens, from 0) and ``links`` (a's id * 2^32 + b's id)."""
    names = [c for c in tokens.columns if c not in ("a_last", "b_last", "links")]
    cuts, found = free_name("cuts", tokens), free_name("found", tokens)
    a_ids, a_ends, b_ids, b_ends = (F.col(c) for c in TOKENS)

    def places(marks: Column) -> Column:
        return _let(_places(a_ends, marks), lambda a_last: _let(_places(b_ends, marks), lambda b_last: result(a_last, b_last)))

    def result(a_last: Column, b_last: Column) -> Column:
        links = _let(a_ids, lambda a: _let(b_ids, lambda b: _links(a, b, a_last, b_last)))
        return F.struct(a_last.alias("a_last"), b_last.alias("b_last"), links.alias("links"))

    none = F.struct(*(F.array().cast(kind).alias(n) for n, kind in (("a_last", "array<int>"), ("b_last", "array<int>"), ("links", "array<bigint>"))))
    own = tokens.withColumn(cuts, F.array_intersect(a_ends, b_ends))
    own = own.withColumn(found, F.when(F.size(cuts) > 0, _let(_let(F.col(cuts), _marks), places)).otherwise(none))
    return own.select(*columns_of(own, names), f"{found}.a_last", f"{found}.b_last", f"{found}.links")


def groups(aligned: DataFrame, into: str = "groups") -> DataFrame:
    """``aligned`` with its groups as arrays of both sides' ids: array<struct<a: array<int>, b: array<int>>>."""

    def side(ids: str, last: str) -> Column:
        parts = _let(F.col(ids), lambda own: F.zip_with(last, _before(F.col(last), -1), lambda end, before: F.slice(own, before + 2, end - before)))
        return F.when(F.size(last) > 0, parts).otherwise(F.array().cast("array<array<int>>"))

    return aligned.withColumn(into, F.zip_with(side("a_ids", "a_last"), side("b_ids", "b_last"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def groups_text() -> Column:
    """The groups of an aligned row as text: ``a1,a2|b1;a3|b2,b3``; empty where there are none."""

    def part(own: Column, end: Column, before: Column) -> Column:
        # nearly all groups have one or two tokens of a side, which need no arrays of their own
        two = F.concat(F.get(own, before + 1), F.lit(","), F.get(own, end))
        return F.when(end - before == 1, F.get(own, end)).when(end - before == 2, two).otherwise(F.array_join(F.slice(own, before + 2, end - before), ","))

    def side(ids: str, last: str) -> Column:
        return _let(F.col(ids).cast("array<string>"), lambda own: F.zip_with(last, _before(F.col(last), -1), lambda end, before: part(own, end, before)))

    text = F.array_join(F.zip_with(side("a_ids", "a_last"), side("b_ids", "b_last"), lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    return F.when(F.size("a_last") > 0, text).otherwise("")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best) of all links: how often the pair is linked, and whether no other pair of its b id is linked more often."""
    counted = linked.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return counted.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """For each document: n_a, n_b, n_groups, n_links, n_best, count_sum and the digest of its groups' text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text = groups_text()
    rows = staged(
        align(tokenise(own, path_a, path_b)).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.size("a_ids").cast("long").alias("n_a"),
            F.size("b_ids").cast("long").alias("n_b"),
            F.size("a_last").cast("long").alias("n_groups"),
            F.size("links").cast("long").alias("n_links"),
            F.when(F.size("a_ids") > 0, F.sha2(text.cast("binary"), 256)).otherwise("").alias("groups_sha256"),
            "links",
        ),
        "aligned",
    )
    counts = staged(pair_counts(rows), "pairs")
    found = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts.hint("merge")
    sums = (
        rows.select("row", F.explode("links").alias("pair"))
        .join(found, "pair")
        .groupBy("row")
        .agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    )
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_best", "count_sum")}
    return rows.drop("links").join(sums, "row", "left").withColumns(zero).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
