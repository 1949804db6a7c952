import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lockstep.llm.mpeg_audio import crc16, header, op8_mpeg_audio, pad, read_audio, read_media, read_payload, store_texts, write_audio


@given(st.binary(max_size=6000))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    payload = pad(data)
    stream = write_audio(payload)
    audio = read_audio(stream)
    assert read_payload(stream, audio) == payload
    assert audio.failed == 0 and audio.checked == len(audio.offsets) == audio.table_frames
    assert audio.samples == 1152 * len(audio.offsets) and audio.rate == 48_000 and audio.skipped == 0
    assert audio.table == "Xing" and audio.table_bytes == len(stream) - (audio.offsets[0] - 168)
    assert all(header(stream[o : o + 4]) for o in audio.offsets)


def test_payload_full_of_false_syncs():
    payload = b"\xff\xfa\xe4\xc4" * 2000
    stream = write_audio(payload)
    assert read_payload(stream, read_audio(stream)) == payload


def test_resynchronises_after_damage():
    stream = write_audio(pad(bytes(range(256)) * 40))
    clean = read_audio(stream)
    junk = b"\xffjunk\xff\xe0" * 9
    cut = clean.offsets[3]
    found = read_audio(stream[:cut] + junk + stream[cut:] + b"TAG" + b"name".ljust(125, b"\0"))
    assert len(found.offsets) == len(clean.offsets) and found.skipped == len(junk)
    assert found.tags["title"] == "name"
    assert found.offsets[3] == cut + len(junk)


def test_checksum_sees_changed_side_information():
    stream = bytearray(write_audio(pad(b"x" * 3000)))
    at = read_audio(bytes(stream)).offsets[1]
    stream[at + 10] ^= 1
    assert read_audio(bytes(stream)).failed == 1


def test_crc_and_headers_known_values():
    assert crc16(b"123456789") == 0xAEE7  # the catalogue's CRC-16/CMS
    h = header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.kbits, h.rate, h.size, h.samples, h.mono) == (128, 44_100, 417, 1152, False)
    assert header(b"\xff\xff\xff\xff") is None and header(b"abcd") is None


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"no audio at all" * 50, b"\xff\xfb\x90\x00"])
def test_foreign_bytes(data):
    assert read_audio(data).offsets == []


def test_query_against_plain_python(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_mpeg_audio(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = pad(rows[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes) == (len(rows[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(write_audio(payload)).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "é" * 5000, "c"), (2, "é" * 5000, "d")], "doc_id long, text string, media string")
    got = read_media(store_texts(docs)).collect()
    assert sorted(len(r.payload) for r in got) == [64, 64, 10048, 10048]
    assert len({bytes(r.media) for r in got}) == 2
    assert read_media(store_texts(docs.limit(0))).count() == 0
