"""Secrets in whole texts and in what the texts hold in encoded form.

A text is scanned by three base patterns. Then a worklist of layers: of each layer, all URL and Unicode escapes are replaced where they stand (the new text
is a layer), and each base64 run that decodes to text, or to compressed bytes, is a layer of its own, as are escaped bytes that are compressed. Layers are
scanned and unwrapped in turn until nothing new comes. A layer is known by the digest of its text and by the place in the document that it comes from; what is known
is not taken again, which ends cycles, as of an archive that unpacks to itself.

Every find is mapped back, layer by layer, to code points of the document: through escapes and base64 to the characters that spell it, through compression to all of
the compressed run. Finds that a base span of their kind covers add nothing.

Defined results: null text is empty and has no spans; spans are in code points, end exclusive, in order of start, then kind, then end; equal finds of several
layers are one; repeated rows get equal results; other columns of the caller pass through scan(), but for those of its output's names; an empty table gives an
empty result. Texts are read whole. One layer unpacks to LAYER bytes at most and all of a document's to TOTAL characters; ``whole`` is false for
a document that holds more (an archive bomb), and only for such.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_arrow_batches

KINDS = ("assign", "access", "hex")
LAYER, TOTAL = 32 << 20, 256 << 20
SPAN = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("way", T.StringType()).add("base", T.BooleanType())

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
# runs are maximal, so that one which is too short holds no match and needs no retry
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}+"), re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));")
_ESCAPED_BYTES = re.compile(r"(?:(?:%|\\x)[0-9A-Fa-f]{2}){10,}+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]{16,}+)*+(?:\r?\n[A-Za-z0-9+/_-]++(?==))?")
_URL_SAFE = str.maketrans("-_", "+/", "\r\n")

Place = Callable[[int, int], tuple[int, int]]


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def _letter(m: re.Match) -> str:
    """What an escape stands for. Secrets are ASCII, so any other character may stand as U+FFFD."""
    digits = next(x for x in m.groups() if x)
    code = int(digits, 10 if m[6] else 16)
    return chr(code) if code < 128 else "�"


def unescaped(text: str) -> tuple[str, Place] | None:
    """The text with all its escapes replaced, and the place of a span of it in the text that was given; None without escapes."""
    parts, last, out = [], 0, 0
    at, starts, ends = [], [], []
    for m in _ESCAPE.finditer(text):
        parts += [text[last : m.start()], _letter(m)]
        out += m.start() - last
        at.append(out)
        starts.append(m.start())
        ends.append(m.end())
        out, last = out + 1, m.end()
    if not at:
        return None
    parts.append(text[last:])

    def source(p: int) -> tuple[int, int]:
        k = bisect_right(at, p) - 1
        if k < 0:
            return p, p + 1
        if at[k] == p:
            return starts[k], ends[k]
        return (q := ends[k] + p - at[k] - 1), q + 1

    return "".join(parts), lambda start, end: (source(start)[0], source(end - 1)[1])


def unpacked(data: bytes, limit: int = LAYER) -> tuple[bytes, bool] | None:
    """Bytes of which at least one form of compression knows the beginning, and whether that is all of them; None for others."""
    try:
        if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0):
            out = b""
            while data and len(out) <= limit:
                one = zlib.decompressobj(47)
                out += one.decompress(data, limit + 1 - len(out))
                data = one.unused_data
        elif data[:3] == b"BZh":
            out = bz2.BZ2Decompressor().decompress(data, limit + 1)
        elif data[:6] == b"\xfd7zXZ\x00":
            out = lzma.LZMADecompressor().decompress(data, limit + 1)
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            import io

            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
                out = reader.read(limit + 1)
        else:
            return None
    except Exception as e:  # each library has errors of its own for damaged data
        if isinstance(e, (MemoryError, ImportError)):
            raise
        return None
    return out[:limit], len(out) <= limit


def _base64_bytes(run: str, skip: int = 0) -> bytes:
    letters = run.translate(_URL_SAFE)[skip:]
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    try:
        return base64.b64decode(letters + "=" * (-len(letters) % 4))
    except binascii.Error:
        return b""


def _readable(data: bytes) -> str | None:
    """The bytes as text if nine in ten of its characters can stand in one."""
    text = data.decode("utf-8", "replace")
    bad = sum(c == "�" or (c < " " and c not in "\t\r\n") for c in text)
    return text if 10 * bad <= len(text) else None


class Document:
    """The worklist of one document."""

    def __init__(self, text: str, limit: int = LAYER, total: int = TOTAL):
        self.text, self.limit, self.left, self.whole, self.layers = text, limit, total, True, 0
        self.base = matches(text)
        self.covered = [[(s, e) for s, k, e in self.base if k == kind] for kind in range(len(KINDS))]
        self.known: set[tuple[bytes, int, int]] = {(self._digest(text), 0, len(text))}
        self.added: dict[tuple[int, int, int], str] = {}
        work: list[tuple[str, Place, str]] = [(text, lambda start, end: (start, end), "")]
        while work:
            work += self._unwrap(*work.pop())

    @staticmethod
    def _digest(text: str) -> bytes:
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def _layer(self, text: str, place: Place, way: str) -> Iterator[tuple[str, Place, str]]:
        """A new layer, scanned; nothing if it is known."""
        key = (self._digest(text), *place(0, len(text))) if text else None
        if key is None or key in self.known:
            return
        if len(text) > self.left:
            self.whole = False
            return
        self.left -= len(text)
        self.known.add(key)
        self.layers += 1
        for start, kind, end in matches(text):
            start, end = place(start, end)
            near = bisect_right(self.covered[kind], (start, len(self.text) + 1)) - 1
            if near < 0 or self.covered[kind][near][1] < end:
                self.added.setdefault((start, kind, end), way)
        yield text, place, way

    def _unwrap(self, text: str, place: Place, way: str) -> Iterator[tuple[str, Place, str]]:
        if "%" in text or "\\" in text or "&#" in text:
            if found := unescaped(text):
                own, inner = found
                yield from self._layer(own, lambda start, end: place(*inner(start, end)), f"{way}/escape")
                for m in _ESCAPED_BYTES.finditer(text):
                    data = bytes.fromhex(re.sub(r"%|\\x", "", m[0]))
                    yield from self._compressed(data, place(m.start(), m.end()), f"{way}/escape")
        for m in _BASE64.finditer(text):
            yield from self._base64(m[0], m.start(), place, f"{way}/base64")

    def _base64(self, run: str, start: int, place: Place, way: str) -> Iterator[tuple[str, Place, str]]:
        """What a run decodes to as a whole; if that is nothing, what its lines do, then what is left without its first letters."""
        data = _base64_bytes(run)
        if unpacked(data, 1):
            yield from self._compressed(data, place(start, start + len(run)), way)
            return
        try:
            own = data.decode()
        except UnicodeDecodeError:
            lines = list(re.finditer(r"[^\r\n]+", run))
            if len(lines) > 1:
                for line in lines:
                    yield from self._base64(line[0], start + line.start(), place, way)
                return
            for skip in range(4):
                data = _base64_bytes(run, skip)
                if unpacked(data, 1):
                    yield from self._compressed(data, place(start + skip, start + len(run)), way)
                elif own := _readable(data):
                    yield from self._layer(own, self._through(run, start, skip, own, place), way)
            return
        yield from self._layer(own, self._through(run, start, 0, own, place), way)

    @staticmethod
    def _through(run: str, start: int, skip: int, own: str, place: Place) -> Place:
        """Places of the letters that spell the decoded text."""

        def source(first: int, end: int) -> tuple[int, int]:
            at = [i for i, c in enumerate(run) if c not in "\r\n"] if "\n" in run else range(len(run))
            before, through = (len(own[:p].encode("utf-8", "replace")) for p in (first, end))
            # a replaced character may stand for fewer bytes than it has itself; spans then end with the run at the latest
            last = min(skip + -(-through * 8 // 6) - 1, len(at) - 1)
            return place(start + at[min(skip + before * 8 // 6, last)], start + at[last] + 1)

        return source

    def _compressed(self, data: bytes, at: tuple[int, int], way: str) -> Iterator[tuple[str, Place, str]]:
        seen: set[bytes] = set()
        while (digest := hashlib.blake2b(data, digest_size=16).digest()) not in seen and (found := unpacked(data, self.limit)):
            seen.add(digest)
            data, all_of_it = found
            self.whole &= all_of_it
            way = f"{way}/compressed"
        if seen and data:
            yield from self._layer(data.decode("utf-8", "replace"), lambda start, end: at, way)

    def spans(self) -> list[dict]:
        own = [(*x, "", True) for x in self.base] + [(*x, way, False) for x, way in self.added.items()]
        return [{"kind": KINDS[k], "start": s, "end": e, "way": way.lstrip("/"), "base": base} for s, k, e, way, base in sorted(own)]


def masked(text: str, spans: list[dict], mask: str = "[secret]") -> str:
    """The text with what the spans cover, overlapping ones as one, replaced."""
    parts, last = [], 0
    for x in spans:  # by start
        if x["start"] >= last:
            parts += [text[last : x["start"]], mask]
        last = max(last, x["end"])
    return "".join(parts) + text[last:]


def scan(docs: DataFrame, text_col: str = "text", mask: str | None = None) -> DataFrame:
    """``docs`` with ``secrets`` (kind, start, end, way: the layers that led there, base), ``n_layers`` and ``whole``.

    The text stays out, unless ``mask`` is given: then it stays, with every secret replaced by it.
    """
    small_arrow_batches(docs.sparkSession)
    made = T.StructType().add("secrets", T.ArrayType(SPAN)).add("n_layers", T.LongType()).add("whole", T.BooleanType())
    taken = {f.name for f in made.fields} | {text_col.lower()}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken]
    text = [T.StructField(text_col, T.StringType())] if mask is not None else []
    schema = T.StructType(kept + text + made.fields)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("way", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_col)).to_pylist()
            found = [Document(t or "") for t in texts]
            spans = [d.spans() for d in found]
            columns = [batch.column(i) for i, n in enumerate(names) if n.lower() not in taken]
            if mask is not None:
                columns.append(pa.array([None if t is None else masked(t, s, mask) for t, s in zip(texts, spans)], pa.string()))
            columns += [pa.array(spans, arrow), pa.array([d.layers for d in found], pa.int64()), pa.array([d.whole for d in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: base matches by kind, their digest, all spans, and how many layers it has and whether all were read."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = F.filter("secrets", lambda x: x["base"])
    counts = [F.size(F.filter("secrets", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return scan(own).select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), "n_layers", "whole")
