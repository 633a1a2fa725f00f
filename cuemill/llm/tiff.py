"""TIFF media columns: reading pages, and writing single grey pages."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table

NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
# Fixed values of the format: the struct letter and size of each field type.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4)}
CLEAR, END = 256, 257
SEGMENT = 3837  # codes between two clears
ROW, STRIP_ROWS = 64, 128
FEATURES = ("total", "squares", "zeros", "peak")

_next = 258 + np.maximum(0, np.arange(SEGMENT + 3) - 1)
_WIDTHS = (9 + (_next >= 511) + (_next >= 1023) + (_next >= 2047)).astype(np.int64)
_ENDS = np.cumsum(_WIDTHS)
_SINGLE = [bytes([k]) for k in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    """LZW codes from the high bit down, 9 to 12 bits wide, wider one code early."""
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    out, made, bit, bits = [], 0, 0, len(data) * 8
    while made < size:
        n = int(np.searchsorted(_ENDS, bits - bit, side="right"))
        if not n:
            break
        at = bit + _ENDS[:n] - _WIDTHS[:n]
        b = at >> 3
        word = raw[b] << 24 | raw[b + 1] << 16 | raw[b + 2] << 8 | raw[b + 3]
        codes = (word >> (32 - _WIDTHS[:n] - (at & 7))) & ((1 << _WIDTHS[:n]) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        k = int(stop[0]) if len(stop) else n
        if k:
            entries, run = _SINGLE.copy(), codes[:k].tolist()
            if run[0] > 255:
                raise ValueError("LZW code before its entry")
            last = entries[run[0]]
            out.append(last)
            made += len(last)
            for c in run[1:]:
                if c < len(entries):
                    e = entries[c]
                elif c == len(entries):
                    e = last + last[:1]
                else:
                    raise ValueError("LZW code before its entry")
                entries.append(last + e[:1])
                out.append(e)
                last = e
            made = made - len(out[-k]) + sum(map(len, out[-k:]))
        if not len(stop) or codes[k] == END:
            break
        bit += int(_ENDS[k])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    segments, codes, known, p = [], [CLEAR], {}, -1
    new = 258
    for b in data:
        if p < 0:
            p = b
            continue
        key = p << 8 | b
        c = known.get(key)
        if c is not None:
            p = c
            continue
        codes.append(p)
        known[key] = new
        new += 1
        p = b
        if len(codes) > SEGMENT - 1:
            segments.append(codes)
            codes, known, new = [CLEAR], {}, 258
    codes += [p] if p >= 0 else []
    segments.append([*codes, END])
    values, widths = [], []
    for k, s in enumerate(segments):
        values.append(np.array(s, np.int64))
        # the first clear is 9 bits wide; a later one is as wide as the code in its place would be
        first = 9 if not k else int(_WIDTHS[len(segments[k - 1]) - 1])
        widths.append(np.r_[first, _WIDTHS[: len(s) - 1]])
    v, w = np.concatenate(values), np.concatenate(widths)
    ends = np.cumsum(w)
    bits = np.zeros(-(-int(ends[-1]) // 8) * 8, np.uint8)
    starts = ends - w
    for k in range(12):
        live = w > k
        bits[starts[live] + k] = (v[live] >> (w[live] - 1 - k)) & 1
    return np.packbits(bits).tobytes()


def packbits_decode(data: bytes, size: int) -> bytes:
    out, made, i, n = [], 0, 0, len(data)
    while i < n and made < size:
        h = data[i]
        if h < 128:
            part = data[i + 1 : i + 2 + h]
            i += 2 + h
        elif h > 128:
            part = data[i + 1 : i + 2] * (257 - h)
            i += 2
        else:
            i += 1
            continue
        out.append(part)
        made += len(part)
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as runs, the rest as literals of at most 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    lengths = np.diff(np.r_[cut, len(a)])
    out, at = [], 0

    def literal(end):
        for k in range(at, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(bytes([len(part) - 1]) + part)

    for s, n in zip(cut[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literal(s)
        for k in range(0, n, 128):
            m = min(128, n - k)
            out.append(bytes([(257 - m) & 255, data[s]]) if m > 1 else bytes([0, data[s]]))
        at = s + n
    literal(len(data))
    return b"".join(out)


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, size))


DECODERS = {NONE: lambda d, n: d, LZW: lzw_decode, ADOBE_DEFLATE: _inflate, DEFLATE: _inflate, PACKBITS: packbits_decode}


def directories(data: bytes):
    """The fields {tag: values} of each image directory in the chain; a directory met twice ends it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            letter, each = TYPES.get(kind, ("", 0))
            if not letter:
                continue
            where = at + 10 + 12 * k
            if each * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            fields[tag] = struct.unpack_from(f"{order}{count * len(letter)}{letter[0]}", data, where)
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def page_pixels(data: bytes, order: str, f: dict) -> tuple[dict, bytes]:
    """The shape of a page, and its samples row by row: packed to bytes per row, wider samples little-endian."""
    one = lambda tag, default: f.get(tag, (default,))[0]
    shape = {"width": one(256, 0), "height": one(257, 0), "bits": one(258, 1), "samples": one(277, 1), "compression": one(259, 1), "predictor": one(317, 1)}
    w, h, bits, samples = (shape[k] for k in ("width", "height", "bits", "samples"))
    if len(set(f.get(258, (1,)))) > 1:
        raise ValueError("samples of different widths")
    decode = DECODERS.get(shape["compression"])
    if not decode:
        raise ValueError(f"compression {shape['compression']}")
    apart = one(284, 1) == 2
    tiled = 322 in f
    tw, th = (one(322, w), one(323, h)) if tiled else (w, min(one(278, h), h))
    offsets, counts = (f.get(324, ()), f.get(325, ())) if tiled else (f.get(273, ()), f.get(279, ()))
    across, down = (-(-w // tw) if tw else 0), (-(-h // th) if th else 0)
    planes, each = (samples, 1) if apart else (1, samples)
    line, full = -(-tw * each * bits // 8), -(-w * each * bits // 8)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("too few strips or tiles")
    if tiled and across > 1 and tw * each * bits % 8:
        raise ValueError("tiles that end within a byte")
    kind = {8: "u1", 16: "u2", 32: "u4", 64: "u8"}.get(bits)
    whole = []
    for p in range(planes):
        page = np.zeros((down * th, across * line), np.uint8)
        for k in range(across * down):
            o, n = offsets[p * across * down + k], counts[p * across * down + k]
            part = data[o : o + n]
            if one(266, 1) == 2:
                part = np.packbits(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")).tobytes()
            y, x = k // across * th, k % across * line
            rows = th if tiled else min(th, h - y)
            got = decode(part, rows * line)[: rows * line]
            if len(got) < rows * line:
                raise ValueError("a strip or tile ends early")
            block = np.frombuffer(got, np.uint8).reshape(rows, line)
            if shape["predictor"] == 2:
                if not kind:
                    raise ValueError("predictor 2 on samples that are not whole bytes")
                wide = block.copy().view(order + kind).reshape(rows, tw, each)
                block = np.cumsum(wide, axis=1, dtype=kind).astype("<" + kind).reshape(rows, -1).view(np.uint8)
            elif shape["predictor"] == 3:
                size = bits // 8
                bytes_ = np.cumsum(block.reshape(rows, -1, each), axis=1, dtype=np.uint8).reshape(rows, size, tw * each)
                block = np.ascontiguousarray(bytes_[:, ::-1].transpose(0, 2, 1)).reshape(rows, line)
            elif kind and bits > 8 and order == ">":
                block = block.copy().view(">" + kind).astype("<" + kind).view(np.uint8)
            page[y : y + rows, x : x + line] = block
        whole.append(page[:h, :full])
    if apart and bits % 8 == 0:
        size = bits // 8
        return shape, np.stack([p.reshape(h, w, size) for p in whole], axis=2).tobytes()
    return shape, b"".join(p.tobytes() for p in whole)


def write_page(pixels: bytes, compression: int = ADOBE_DEFLATE, predictor: int = 1, tiled: bool = False, width: int = ROW) -> bytes:
    """A TIFF file of one page of 8-bit grey samples, `width` a row; tiles are `width` by `width`."""
    rows = len(pixels) // width
    step = width if tiled else STRIP_ROWS
    image = np.frombuffer(pixels, np.uint8).reshape(rows, width)
    if tiled and rows % step:
        image = np.vstack([image, np.zeros((-rows % step, width), np.uint8)])
    if predictor == 2:
        image = np.hstack([image[:, :1], image[:, 1:] - image[:, :-1]])
    encode = {NONE: bytes, LZW: lzw_encode, ADOBE_DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: packbits_encode}[compression]
    parts = [encode(image[k : k + step].tobytes()) for k in range(0, len(image), step)]
    n = len(parts)
    fields = [(256, 4, [width]), (257, 4, [rows]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
    at = np.cumsum([8, *map(len, parts)])[:-1].tolist() if n else []
    sizes = list(map(len, parts))
    fields += [(322, 4, [width]), (323, 4, [step]), (324, 4, at), (325, 4, sizes)] if tiled else [(273, 4, at), (278, 4, [step]), (279, 4, sizes)]
    body = b"".join(parts)
    body += b"\0" * (len(body) % 2)
    extra, entries, ifd = b"", b"", 8 + len(body)
    after = ifd + 2 + 12 * len(fields) + 4
    for tag, kind, values in sorted(fields):
        packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            place = struct.pack("<I", after + len(extra))
            extra += packed
        else:
            place = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    return struct.pack("<2sHI", b"II", 42, ifd) + body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra


PAGE = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, total long, squares long, zeros long, peak int, error string"


def pages(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each page of each TIFF file in the column `media`: df's columns, and those of PAGE.

    total, squares, zeros and peak are features of the pixels' bytes.  A null file, or one that can't be walked, has one
    row with page null and, if not null, an error; a page that can't be decoded has its error and null pixels, and the
    pages after it are read.  Columns of df that clash with PAGE are replaced.  No strip or tile is inflated beyond its size.
    """
    kept = [n for n in df.columns if n not in {x.split()[0] for x in PAGE.split(", ")}]
    df = df.select(*kept)
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(PAGE).fields])
    names = [x.split()[0] for x in PAGE.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in PAGE.split(", ")]

    def walk(data):
        if data is None:
            yield dict.fromkeys(names)
            return
        page = -1
        try:
            for page, (order, f) in enumerate(directories(data)):
                row = dict.fromkeys(names) | {"page": page}
                try:
                    shape, pixels = page_pixels(data, order, f)
                    n = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                    level = np.arange(256)
                    row |= shape | {"pixels": pixels, "total": int(n @ level), "squares": int(n @ level**2), "zeros": int(n[0]), "peak": int(n.argmax())}
                except (ValueError, struct.error, zlib.error, OverflowError, MemoryError, IndexError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                yield row
        except (ValueError, struct.error, OverflowError, MemoryError) as e:
            yield dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}

    @lean
    def read(batches):
        for b in batches:
            rows, of = [], []
            for k, data in enumerate(b.column(b.schema.get_field_index(media)).to_pylist()):
                for row in walk(data):
                    rows.append(row)
                    of.append(k)
            kept_rows = b.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept_rows.columns, *(pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True))], names=[*b.schema.names, *names])

    return df.mapInArrow(read, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a one-page TIFF, 64 bytes a row, padded with 0.

    The text's checksum chooses how it is stored: deflated strips with horizontal differences, PackBits tiles, or LZW
    strips; equal texts give equal files.  A null text is empty; repeated rows have a file each.  Texts are stored whole, up
    to what the format's 32-bit offsets reach (4 GiB; a Spark string ends at 2).  No documents, no rows.
    """

    @lean
    def encode(batches):
        for b in batches:
            sizes, files = [], []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                payload = raw + b"\0" * (-len(raw) % ROW or (ROW if not raw else 0))
                how = zlib.crc32(raw) % 3
                files.append(write_page(payload, (ADOBE_DEFLATE, PACKBITS, LZW)[how], 2 if how == 0 else 1, tiled=how == 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def op6_tiff(spark, sf_dir) -> DataFrame:
    out = pages(text_media(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d c%d total=%d squares=%d zeros=%d peak=%d", "width", "height", "compression", *FEATURES).alias("feature"),
    )
