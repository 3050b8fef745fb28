import hashlib
import zlib

import numpy as np
import pytest

from tideline.llm import jpeg

from .helpers import docs, empty


class Writer:
    """A plain bit-by-bit writer of progressive scans, with tables that give codes to all symbols in use."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, table, s):
        self.put(*table.codes[s])

    def number(self, v, size):
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def data(self):
        return jpeg.stuffed(jpeg.packed(np.array(self.bits, np.uint8)))


def size_of(v):
    return int(abs(v)).bit_length()


DC = jpeg.Huffman(*jpeg.by_length({s: 4 for s in range(12)}))
AC = jpeg.Huffman(*jpeg.by_length({(r << 4) | s: 8 for r in range(16) for s in range(11)}))


def shifted(v, al):
    return int(np.sign(v)) * (abs(int(v)) >> al)


def encode(coef, width, height, h, v, restart=0):
    """coef: for each component blocks (high, wide, 64) in zigzag order."""
    n = len(coef)
    hm, vm = max(h), max(v)
    mcus = (-(-width // (8 * hm)), -(-height // (8 * vm)))
    out = [b"\xff\xd8", jpeg.marker(0xDB, b"\0" + bytes(range(1, 65)))]
    out.append(jpeg.marker(0xC2, jpeg.struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h[i] << 4 | v[i], 0]) for i in range(n))))
    out.append(jpeg.marker(0xC4, jpeg.huffman_body(0, DC) + jpeg.huffman_body(0x10, AC)))
    if restart:
        out.append(jpeg.marker(0xDD, jpeg.struct.pack(">H", restart)))

    def scan(comps, ss, se, ah, al, units):
        head = jpeg.marker(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), ss, se, ah << 4 | al]))
        groups = [units] if not restart else [units[i : i + restart] for i in range(0, len(units), restart)]
        body = b""
        for g, mcu in enumerate(groups):
            if g:
                body += bytes([0xFF, 0xD0 + (g - 1) % 8])
            body += write_group(mcu, ss, se, ah, al)
        out.append(head + body)

    def write_group(mcu, ss, se, ah, al):
        w, last = Writer(), {}
        blocks = [u for m in mcu for u in m]
        if ss == 0:
            for c, y, x in blocks:
                value = int(coef[c][y, x, 0]) >> al
                if ah:
                    w.put(value & 1, 1)
                    continue
                d = value - last.get(c, 0)
                last[c] = value
                w.symbol(DC, size_of(d))
                w.number(d, size_of(d)) if d else None
            return w.data()
        run, fixes = 0, []

        def flush():
            nonlocal run, fixes
            if run:
                k = run.bit_length() - 1
                w.symbol(AC, k << 4)
                w.put(run - (1 << k), k)
                w.bits += fixes
            run, fixes = 0, []

        for c, y, x in blocks:
            band = [int(t) for t in coef[c][y, x, ss : se + 1]]
            now = [shifted(t, al) for t in band]
            if not ah:
                zeros = 0
                for t in now:
                    if t == 0:
                        zeros += 1
                        continue
                    flush()
                    while zeros > 15:
                        w.symbol(AC, 0xF0)
                        zeros -= 16
                    w.symbol(AC, zeros << 4 | size_of(t))
                    w.number(t, size_of(t))
                    zeros = 0
            else:
                last_new = max((i for i, t in enumerate(now) if abs(t) == 1), default=-1)
                zeros, mine = 0, []
                for i, t in enumerate(now):
                    if abs(t) > 1:
                        mine.append(abs(t) & 1)
                        continue
                    if i > last_new:
                        continue
                    if t == 0:
                        zeros += 1
                        if zeros == 16:
                            flush()
                            w.symbol(AC, 0xF0)
                            w.bits += mine
                            zeros, mine = 0, []
                        continue
                    flush()
                    w.symbol(AC, zeros << 4 | 1)
                    w.put(int(t > 0), 1)
                    w.bits += mine
                    zeros, mine = 0, []
                if mine or last_new < len(now) - 1:
                    run += 1
                    fixes += mine
                continue
            if zeros:
                run += 1
                if run == 0x7FFF:
                    flush()
        flush()
        return w.data()

    def units_of(comps):
        if len(comps) == 1:
            c = comps[0]
            across, down = -(-(-(-width * h[c] // hm)) // 8), -(-(-(-height * v[c] // vm)) // 8)
            return [[(c, y, x)] for y in range(down) for x in range(across)]
        return [[(c, my * v[c] + y, mx * h[c] + x) for c in comps for y in range(v[c]) for x in range(h[c])] for my in range(mcus[1]) for mx in range(mcus[0])]

    every = list(range(n))
    scan(every, 0, 0, 0, 1, units_of(every))
    for c in every:
        scan([c], 1, 5, 0, 2, units_of([c]))
        scan([c], 6, 63, 0, 2, units_of([c]))
    for c in every:
        scan([c], 1, 63, 2, 1, units_of([c]))
    scan(every, 0, 0, 1, 0, units_of(every))
    for c in every:
        scan([c], 1, 63, 1, 0, units_of([c]))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("restart", [0, 3])
def test_general_files(seed, restart):
    rng = np.random.default_rng(seed)
    width, height = int(rng.integers(1, 70)), int(rng.integers(1, 70))
    h, v = ([1], [1]) if seed % 3 == 0 else ([2, 1, 1], [2, 1, 1]) if seed % 3 == 1 else ([2, 1, 1], [1, 1, 1])
    mcus = (-(-width // (8 * max(h))), -(-height // (8 * max(v))))
    coef = []
    for i in range(len(h)):
        c = rng.integers(-40, 41, (mcus[1] * v[i], mcus[0] * h[i], 64)) * (rng.random((mcus[1] * v[i], mcus[0] * h[i], 64)) < rng.choice([0.02, 0.2, 0.9]))
        coef.append(c)
    image = jpeg.read(encode(coef, width, height, h, v, restart))
    hm, vm = max(h), max(v)
    for i, c in enumerate(image.components):
        across, down = -(-(-(-width * h[i] // hm)) // 8), -(-(-(-height * v[i] // vm)) // 8)
        got = c.coef.reshape(c.high, c.wide, 64)
        assert (got[:down, :across, 1:] == coef[i][:down, :across, 1:]).all()
        assert (got[:down, :across, 0] == coef[i][:down, :across, 0]).all()
    pixels = jpeg.rgb(image)
    assert pixels.shape == (height, width, 3)
    # the inverse transform by its definition, on one block
    c = image.components[0]
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = c.coef[0] * image.quant[0]
    f = block.reshape(8, 8)
    k = np.arange(8)
    cos = np.where(k[:, None] == 0, 0.5**0.5, 1) * 0.5 * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    assert np.allclose(jpeg.planes(image)[0][:8, :8], cos.T @ f @ cos + 128, atol=1e-2)


@pytest.mark.parametrize("n", [1, 2, 6, 7, 37, 500])
def test_payloads(n):
    p = np.random.default_rng(n).integers(0, 256, 64 * n).astype(np.uint8).tobytes()
    assert jpeg.payload_of(jpeg.read(jpeg.write(p)), n) == p


def test_broken_files():
    good = jpeg.write(b"\0" * 64)
    for bad in (b"", good[:-2], good.replace(b"\xff\xc2", b"\xff\xc0"), good[:300]):
        with pytest.raises((ValueError, IndexError)):
            jpeg.read(bad)


def test_query(spark):
    df = docs(spark)
    got = jpeg.decode(jpeg.store(df.repartition(2)), tensors=True).collect()
    assert len(got) == df.count()
    want = {}
    for r in df.collect():
        raw = (r.text or "").encode()
        p = jpeg.padded(raw)
        want.setdefault(r.doc_id, []).append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
        assert len(r.rgb) == 3 * r.height * r.width
    assert len({r.media_sha256 for r in got if r.doc_id in (1, 6)}) == 1
    assert jpeg.decode(jpeg.store(empty(spark))).count() == 0


class Java:
    """The JVM's own JPEG codec: an encoder and a decoder that share nothing with this one."""

    def __init__(self, spark):
        self.jvm = spark._jvm
        self.io = self.jvm.javax.imageio.ImageIO

    def encode(self, pixels, grey=False, quality=0.92):
        h, w, _ = pixels.shape
        image = self.jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
        for y in range(h):
            for x in range(w):
                for band, v in enumerate(pixels[y, x][: 1 if grey else 3]):
                    image.getRaster().setSample(x, y, band, int(v))
        writer = self.io.getImageWritersByFormatName("jpeg").next()
        how = writer.getDefaultWriteParam()
        how.setProgressiveMode(1)
        how.setCompressionMode(2)
        how.setCompressionQuality(quality)
        out = self.jvm.java.io.ByteArrayOutputStream()
        stream = self.io.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, self.jvm.javax.imageio.IIOImage(image, None, None), how)
        stream.flush()
        return bytes(out.toByteArray())

    def decode(self, data):
        image = self.io.read(self.jvm.java.io.ByteArrayInputStream(bytearray(data)))
        w, h = image.getWidth(), image.getHeight()
        raster = image.getRaster()
        bands = raster.getNumBands()
        return np.array([raster.getSample(x, y, k) for y in range(h) for x in range(w) for k in range(bands)]).reshape(h, w, bands)


@pytest.mark.parametrize("shape,grey", [((24, 40), False), ((33, 17), False), ((19, 23), True)])
def test_files_of_another_encoder(spark, shape, grey):
    """Progressive files that the JVM wrote: the pixels are those that the JVM reads, but for the rounding of transforms and of chroma between samples."""
    h, w = shape
    y, x = np.mgrid[:h, :w]
    pixels = np.stack([x * 255 // w, y * 255 // h, (x + y) * 255 // (w + h)], axis=2)
    if grey:
        pixels = np.repeat(pixels[:, :, :1], 3, axis=2)
    java = Java(spark)
    data = java.encode(pixels, grey)
    assert b"\xff\xc2" in data and data.count(b"\xff\xda") > 3  # progressive, in many scans
    image = jpeg.read(data)
    got = jpeg.rgb(image).astype(int)
    assert got.shape == (h, w, 3)
    other = java.decode(data)
    assert np.abs(got - other).mean() < 2.5 and np.abs(got - other).max() < (2 if grey else 24)
    assert np.abs(got - pixels).mean() < 4


def test_the_other_decoder_reads_the_writer(spark):
    """A payload's file is a progressive JPEG for the JVM too; its luma, which chroma cannot blur, is the same picture."""
    data = jpeg.write(jpeg.padded(bytes(range(256)) * 4))
    mine, other = jpeg.rgb(jpeg.read(data)).astype(int), Java(spark).decode(data)
    assert mine.shape == other.shape
    luma = lambda p: p @ np.array([0.299, 0.587, 0.114])
    inside = ((mine > 0) & (mine < 255) & (other > 0) & (other < 255)).all(axis=2)  # clipped colours lose their luma
    assert inside.sum() > 50 and np.abs(luma(mine) - luma(other))[inside].mean() < 3
