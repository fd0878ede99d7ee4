import random

import pytest

from souklens.llm import media_tiff as m


@pytest.mark.parametrize("compression", [m.NONE, m.LZW, m.DEFLATE, m.PACKBITS])
@pytest.mark.parametrize("how", [{}, {"tile": 16, "predictor": 1}, {"samples": 3, "width": 64, "order": ">"}, {"tile": 32, "page_rows": 7}])
def test_round_trip(compression, how):
    r = random.Random(4)
    for n in (1, 5, 40):
        data = bytes(r.choice(b"aaaabbbb  ccc\x00\xff") for _ in range(192 * n))
        pages = m.decode_tiff(m.encode_tiff(data, compression=compression, **how))
        assert b"".join(p.pixels for p in pages) == data
        assert len(pages) == -(-n // how.get("page_rows", 1024))


def test_codecs_on_odd_data():
    r = random.Random(1)
    for data in (b"", b"a", b"a" * 1000, bytes(range(256)) * 60, bytes(r.randrange(256) for _ in range(30000)), b"ab" * 20000):
        assert m.unpack_bits(m.pack_bits(data)) == data
        assert m.lzw_decode(m.lzw_encode(data)) == data
    assert m.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_table(spark):
    rows = [(1, "é" * 500, "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 192 * 2000, "x"), (None, "t", None)]
    df = m.store_as_tiff(spark.createDataFrame(rows, "doc_id long, text string, feature string"))
    got = {r.doc_id: r for r in m.read_tiff(df).collect()}
    for d, t, _ in rows:
        data = b"".join(bytes(p.pixels) for p in got[d].pages)
        raw = (t or "").encode()
        assert data.startswith(raw) and not data[len(raw) :].strip() and len(data) % 192 == 0 and data and got[d].n_bytes == len(raw) and got[d].error is None
    assert m.tiff_pages(df).where("doc_id = 4").count() == 2
    bad = spark.createDataFrame([(1, b"II*\0junkjunk"), (2, None), (3, b"PNG")], "doc_id long, media binary")
    assert sorted((r.doc_id, r.error is None, len(r.pages)) for r in m.read_tiff(bad).collect()) == [(1, False, 0), (2, True, 0), (3, False, 0)]
    assert m.read_tiff(bad.limit(0)).count() == 0


def test_broken_files_cost_no_others(spark):
    """Files without size, of absurd size, cut short: each is a row with an error."""
    good = m.encode_tiff(b"x" * 1920)
    no_width, huge = bytearray(good), bytearray(good)
    for k in range(12):
        at = len(good) - 4 - 12 * (12 - k)
    entries = good.index(b"\x00\x01\x04\x00")  # tag 256, kind 4
    no_width[entries + 8 : entries + 12] = b"\0\0\0\0"
    huge[entries + 8 : entries + 12] = huge[entries + 20 : entries + 24] = b"\xff\xff\xff\x7f"
    del at
    rows = [(1, good), (2, bytes(no_width)), (3, bytes(huge)), (4, good[:40]), (5, None), (6, b"")]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    assert {r.doc_id: (r.error is None, len(r.pages)) for r in m.read_tiff(df).collect()} == {1: (True, 1), 2: (False, 0), 3: (False, 0), 4: (False, 0), 5: (True, 0), 6: (False, 0)}
    assert sorted((r.doc_id, r.page) for r in m.tiff_pages(df).select("doc_id", "page").collect() if r.page is not None) == [(1, 0)] and m.tiff_pages(df).count() == 6


def test_lzw_and_deflate_of_others():
    """Vectors made by hand: the codes 256, 7, 258, 8, 8, 258, 6, 6, 257 of 9 bits each; a raw zlib stream."""
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    pad = -len(codes) * 9 % 8
    assert m.lzw_decode((bits << pad).to_bytes((len(codes) * 9 + pad) // 8, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_query(spark, tmp_path):
    """The registered query on a small table, against the contract's own words."""
    import hashlib
    import zlib

    from souklens.llm.queries import op2_tiff_pages

    r = random.Random(3)
    texts = [None, "", "a", "é" * 96, "x" * 192] + ["".join(r.choice("ab \n") for _ in range(r.randint(1, 30000))) for _ in range(40)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in op2_tiff_pages(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts + texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        x = got[k]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        same = got[k % len(texts)]
        assert (x.media_sha256, x.media_bytes, x.feature) == (same.media_sha256, same.media_bytes, same.feature)
