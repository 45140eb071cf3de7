import hashlib
import zlib

import numpy as np
import pytest

from kvspark.llm import media


def mulaw_by_rule(code):
    code = ~code & 255
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return (-size if code & 128 else size) * 4


def alaw_by_rule(code):
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    size = (mantissa * 2 + 1) if exponent == 0 else (mantissa * 2 + 33) << (exponent - 1)
    return (size if code & 128 else -size) * 8


def test_tables():
    assert media.mulaw_table().tolist() == [mulaw_by_rule(c) for c in range(256)]
    assert media.alaw_table().tolist() == [alaw_by_rule(c) for c in range(256)]
    assert (media.mulaw_table().min(), media.alaw_table().max()) == (-32124, 32256)


def adpcm_by_sample(data, block):
    out = []
    for at in range(0, len(data) - block + 1, block):
        value, index = int.from_bytes(data[at : at + 2], "little", signed=True), min(data[at + 2], 88)
        out.append(value)
        for byte in data[at + 4 : at + block]:
            for code in (byte & 15, byte >> 4):
                step = int(media.IMA_STEPS[index])
                change = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    change += part if code & bit else 0
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.IMA_INDEX[code & 7])))
                out.append(value)
    return out


def test_adpcm_across_blocks():
    data = np.random.default_rng(1).integers(0, 256, 36 * 50 + 7, dtype=np.uint8).tobytes()
    assert media.decode_adpcm(data, 36).tolist() == adpcm_by_sample(data, 36)


def test_resample():
    pcm = np.array([0, 100, -100, 7], dtype=np.int16)
    assert media.resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, -47, 7, 7]
    assert media.resample(pcm, 16000, 8000).tolist() == [0, -100]
    assert media.resample(pcm, 8000, 8000).tolist() == pcm.tolist()


def test_wave_round_trip():
    for data in (b"", b"a", b"ab"):
        assert media.unwrap(media.wrap(data, media.ALAW)) == (media.ALAW, 8000, 1, 8, data)
    for bad in (b"", b"RIFF", media.wrap(b"abcd")[:-2]):
        with pytest.raises(ValueError):
            media.unwrap(bad)


def test_decode_column(spark):
    wave = media.wrap(bytes(range(256)), media.MULAW)
    rows = [(1, bytearray(wave)), (2, None), (None, bytearray(b"noise")), (3, bytearray(media.wrap(bytes(72), media.ADPCM, block=36, bits=4)))]
    got = {r["key"]: r for r in media.decode_media(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    pcm = np.frombuffer(got[1]["pcm"], dtype="<i2")
    assert got[1]["samples"] == 512 and pcm[::2].tolist() == media.mulaw_table().tolist()
    assert got[2]["pcm"] is None and got[None]["samples"] is None and got[3]["samples"] == 260


def test_documents(spark, documents):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 96), (5, "é" * 97), (None, "abc"), (6, "long " * 30_000)]
    got = {r["doc_id"]: r for r in media.telephony_digest(documents(rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded)) and len(padded) % 192 == 0 < len(padded)
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-16:])
        assert r["media_bytes"] == len(media.wrap(padded)) and r["media_sha256"] == hashlib.sha256(media.wrap(padded)).hexdigest()
    assert got[1]["feature"] == got[None]["feature"] and got[2]["feature"] == got[3]["feature"]
    assert media.telephony_digest(documents([])).count() == 0
    made = {r["doc_id"]: r for r in media.telephony_media(documents(rows)).collect()}
    for i, t in rows:
        data, told = bytes(made[i]["payload"]), dict((x.split(";")[0], x) for x in got[i]["feature"].split("|"))
        assert bytes(made[i]["media"]) == media.wrap(data)
        decoded = {"mulaw": [mulaw_by_rule(b) for b in data], "alaw": [alaw_by_rule(b) for b in data]}
        if len(data) < 2000:
            decoded["adpcm"] = adpcm_by_sample(data, 192)
        for kind, x in decoded.items():
            crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
            assert told[kind].endswith(f"peak={max(map(abs, x))};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.2f};zc={crossings}")
        wide = media.resample(np.array(decoded["mulaw"], dtype=np.int16), 8000, 16000)
        assert made[i]["pcm"] == wide.astype("<i2").tobytes()
        assert got[i]["feature"].endswith(f"|pcm16000={len(wide)};crc={zlib.crc32(made[i]['pcm'])}")


def test_adpcm_decodes_a_short_last_block(spark):
    data = np.random.default_rng(2).integers(0, 256, 36 * 5 + 11, dtype=np.uint8).tobytes()
    stereo = bytearray(media.wrap(data, media.ADPCM, block=36, bits=4))
    stereo[22] = 2
    cases = [media.wrap(data, media.ADPCM, rate=16000, block=36, bits=4), media.wrap(data[:-8], media.ADPCM, block=36, bits=4), bytes(stereo)]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "id long, media binary")
    got = {r["key"]: r["pcm"] for r in media.decode_media(frame, "id", "media").collect()}
    want = adpcm_by_sample(data, 36) + adpcm_by_sample(data[-11:], 11)
    assert np.frombuffer(got[0], dtype="<i2").tolist() == want
    assert got[1] is None and got[2] is None
