"""Media columns: Ogg streams, written and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a sample packet, samples a second, and the format's flags.
PACKET, RATE = 16_384, 8_000
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, highest bit first, from 0, unreflected. With the bits of all bytes turned round it is zlib's, but for the inversions."""
    reg = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reg.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule position so far, page) of a logical stream of (packet, granule position at its end); the first packet has a page of its own."""
    out, lacing, body, granule, so_far, number, flags = [], bytearray(), [], -1, 0, 0, FIRST

    def flush(last: bool, continued: bool):
        nonlocal lacing, body, granule, number, flags
        out.append((so_far, _page(flags | LAST * last, granule, serial, number, bytes(lacing), b"".join(body))))
        lacing, body, granule, number, flags = bytearray(), [], -1, number + 1, CONTINUED * continued

    for k, (packet, at) in enumerate(packets):
        last, done = k == len(packets) - 1, 0
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            size = sum(part)
            lacing += part
            body.append(packet[done : done + size])
            done += size
            if not values:
                granule = so_far = at
            if values or len(lacing) == 255 or k == 0 or last:
                flush(last and not values, bool(values))
    return out


def encode(payload: bytes) -> bytes:
    """An Ogg file of two logical streams: 8-bit samples (identification packet, then PACKET samples each), and the checksum of each sample packet. Its serial numbers come from the payload, so that equal payloads give equal files."""
    serial = zlib.crc32(payload)
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(len(payload), i + PACKET) for i in range(0, len(payload), PACKET)]
    samples = _pages(serial, [(b"PCMu8\0\0\0" + struct.pack("<IHH", RATE, 1, 8), 0), *zip(parts, ends)])
    sums = _pages(serial ^ 0xFFFFFFFF, [(b"SUMS\0\0\0\0", 0), *((struct.pack("<I", zlib.crc32(p)), e) for p, e in zip(parts, ends))])
    first, rest = [samples[0], sums[0]], sorted([*((g, 0, p) for g, p in samples[1:]), *((g, 1, p) for g, p in sums[1:])], key=lambda x: x[:2])
    return b"".join([*(p for _, p in first), *(p for _, _, p in rest)])


def decode(data: bytes) -> dict[int, list[tuple[bytes, int, int]]]:
    """By serial number, the packets of each logical stream, each with its granule position (-1 where its page gives none, as for all but the last packet that ends on a page) and page number. Raises ValueError on a wrong checksum, a lost page or packet part, or a stream without end."""
    streams: dict[int, list] = {}
    state: dict[int, tuple[int, bytes | None, bool]] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("cut page")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("not a page")
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if len(page) < size or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("wrong checksum")
        expected, part, ended = state.get(serial, (0, None, False))
        if number != expected or ended or bool(flags & FIRST) != (serial not in state) or bool(flags & CONTINUED) != (part is not None):
            raise ValueError("page out of order")
        got, pos, held = streams.setdefault(serial, []), 27 + n, [part] if part is not None else []
        done = 0
        for v in lacing:
            held.append(page[pos : pos + v])
            pos += v
            if v < 255:
                got.append((b"".join(held), -1, number))
                held, done = [], done + 1
        if done:
            got[-1] = (got[-1][0], granule, number)
        state[serial] = (number + 1, b"".join(held) if held else None, bool(flags & LAST))
        at += size
    if any(part is not None or not ended for _, part, ended in state.values()):
        raise ValueError("stream without end")
    return streams


def samples(data: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """The samples of an encoded file, and start and end of each sample packet in seconds, from granule positions; packets that end within a page are counted back from its last."""
    streams = decode(data)
    main = next((s for s in streams.values() if s and s[0][0][:8] == b"PCMu8\0\0\0"), None)
    sums = next((s for s in streams.values() if s and s[0][0][:4] == b"SUMS"), None)
    if main is None or sums is None:
        raise ValueError("no such streams")
    rate = struct.unpack_from("<I", main[0][0], 8)[0]
    packets = main[1:]
    if [struct.pack("<I", zlib.crc32(p)) for p, _, _ in packets] != [p for p, _, _ in sums[1:]]:
        raise ValueError("streams differ")
    ends: list[int] = [0] * len(packets)
    after = None
    for k in range(len(packets) - 1, -1, -1):
        end = packets[k][1] if packets[k][1] >= 0 else after
        ends[k] = end
        after = end - len(packets[k][0])
    return b"".join(p for p, _, _ in packets), [((e - len(p)) / rate, e / rate) for e, (p, _, _) in zip(ends, packets)]


def _payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def feature(payload: bytes, times: list[tuple[float, float]]) -> str:
    """Duration, packets, mean, root mean square and zero crossings around the middle level, and a histogram of eight levels."""
    x = np.frombuffer(payload, np.uint8)
    y = x.astype(np.int16) - 128
    rms = np.sqrt((y.astype(np.int64) ** 2).sum() / len(y))
    crossings = int(np.count_nonzero((y[1:] >= 0) != (y[:-1] >= 0)))
    levels = np.bincount(x >> 5, minlength=8)
    return f"dur={times[-1][1]:.6f};pkts={len(times)};mean={y.sum(dtype=np.int64) / len(y):.6f};rms={rms:.6f};zc={crossings};hist={','.join(map(str, levels))}"


def _binary(values) -> pa.Array:
    return pa.array(values, pa.binary())


def _encoded(batches):
    for batch in batches:
        doc, texts = batch.column("doc_id"), batch.column("text")
        for i in range(0, batch.num_rows, 500):
            n, media = [], []
            for t in texts.slice(i, 500).to_pylist():
                size, payload = _payload(t)
                n.append(size)
                media.append(encode(payload))
            yield pa.RecordBatch.from_arrays([doc.slice(i, 500), pa.array(n, pa.int64()), _binary(media)], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary) for every row of docs(doc_id long, text string, ...): the text in UTF-8, with bytes 0 up to a positive multiple of 64, as the 8-bit samples of an Ogg file. Null texts are empty. Equal texts give equal media; repeated rows stay; other columns are ignored; an empty table gives no rows. A row's memory is a few times its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def _packets(batches):
    for batch in batches:
        for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
            rows, error = [], None
            try:
                for serial, packets in decode(media or b"").items():
                    rows += [(doc, serial, k, len(p), page, g if g >= 0 else None, zlib.crc32(p)) for k, (p, g, page) in enumerate(packets)]
            except (ValueError, IndexError, struct.error) as e:
                rows, error = [(doc, None, None, None, None, None, None)], str(e)
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[k], pa.int64()) for k in range(7)] + [pa.array([error] * len(rows), pa.string())], names=["doc_id", "serial", "packet", "size", "page", "granule", "crc", "error"])


def packets(media: DataFrame) -> DataFrame:
    """A row for each packet of any Ogg file in media(doc_id long, media binary): its logical stream, number, size, page, granule position (null where the page gives none to it) and CRC-32. A damaged file gives one row with its error; null media give none."""
    return media.select("doc_id", "media").mapInArrow(_packets, "doc_id long, serial long, packet long, size long, page long, granule long, crc long, error string")


def _digested(batches):
    for batch in batches:
        rows = []
        for doc, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
            try:
                payload, times = samples(media or b"")
            except (ValueError, IndexError, struct.error) as e:
                rows.append((doc, n, *[None] * 3, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), f"error: {e}"))
                continue
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, times)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_DIGEST)


_DIGEST = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def digest(media: DataFrame) -> DataFrame:
    """Of each row of media_column(), what its media hold, read back: every page's checksum is verified. Damaged and null media give their row, with what can't be read null and the error as feature."""
    return media.mapInArrow(_digested, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
