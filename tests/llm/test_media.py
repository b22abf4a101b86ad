import hashlib
import json
import struct
import zlib

from hypothesis import given, settings, strategies as st

from reelquery.llm import media


@given(st.binary(max_size=70_000))
@settings(max_examples=40, deadline=None)
def test_round_trip(raw):
    payload = media.padded(raw)
    file = media.mux(payload)
    (track,) = media.probe(file)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw) and media.read_back(file, track) == payload
    assert track["codec"] == "raw" and track["handler"] == "soun" and track["duration"] == len(payload)
    assert track["keys"].tolist() == track["samples"][::16].tolist()


def test_foreign_boxes():
    """A file with 32-bit offsets, sizes of its own, two tracks, an unknown box and data at the front."""
    data = b"abcdefghij"
    mdat = media.box(b"mdat", data)
    head = media.box(b"ftyp", b"isom") + mdat

    def track(entry, sizes, offset, keys, version=0):
        mdhd = media.full(b"mdhd", struct.pack(">IIII", 0, 0, 600, 1200)) if not version else media.box(b"mdhd", struct.pack(">IQQIQ", 1 << 24, 0, 0, 600, 1200))
        tables = [media.full(b"stsd", struct.pack(">I", 1), media.box(entry, bytes(8))), media.full(b"stts", struct.pack(">III", 1, len(sizes), 5)), media.full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), media.full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), media.full(b"stco", struct.pack(">II", 1, offset))]
        if keys is not None:
            tables.append(media.full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
        return media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", media.box(b"stbl", *tables))))

    at = len(head) - len(data)
    file = head + media.box(b"free", b"zz") + media.box(b"moov", track(b"avc1", [3, 4], at, [2]), track(b"mp4a", [1, 2], at + 7, None, 1))
    video, audio = media.probe(file)
    assert (video["codec"], video["duration"], video["keys"].tolist()) == ("avc1", 1200, [[at + 3, 4]])
    assert media.read_back(file, video) == b"abcdefg" and media.read_back(file, audio) == b"hij"
    assert audio["duration"] == 1200 and len(audio["keys"]) == 2
    assert media.probe(b"") == [] and media.probe(b"no media at all") == [] and media.probe(file[: len(file) // 2]) == []


def test_odd_documents(spark, odd, none, texts):
    got = media.digests(media.media_files(odd)).collect()
    want = []
    for doc, text in texts:
        raw = (text or "").encode()
        p = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        want.append((doc, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    files = {r["media_sha256"] for r in got if r["n_bytes"] == len(texts[0][1] or "") and r["payload_sha256"] == got[0]["payload_sha256"]}
    for r in got:
        feature, keys = json.loads(r["feature"]), [tuple(k) for k in r["keyframes"]]
        assert r["codec"] == "raw" and r["duration"] == feature["seconds"] and len(keys) == feature["keyframes"] and [*keys[0]] == feature["first"] and [*keys[-1]] == feature["last"]
        assert len(keys) == -(-r["payload_bytes"] // 1024) and all(n == 64 and 0 < a <= r["media_bytes"] - n for a, n in keys)
    assert len(files) <= 1 and all(json.loads(r["feature"])["codec"] == "raw" for r in got)
    assert media.digests(media.media_files(none)).count() == 0
    tracks = media.probed(media.media_files(odd)).collect()
    assert all(t["tracks"][0]["samples"] == -(-max(t["n_bytes"], 1) // 64) for t in tracks)


def test_fragments():
    """Two fragments of one track: sizes from the run, then from the movie's defaults, a first sample of other flags."""
    trex = media.full(b"trex", struct.pack(">IIIII", 1, 1, 10, 3, media.DEPENDS))
    tables = [media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), media.full(b"stts", bytes(4)), media.full(b"stsc", bytes(4)), media.full(b"stsz", bytes(8)), media.full(b"stco", bytes(4))]
    tkhd, mdhd = media.full(b"tkhd", struct.pack(">III", 0, 0, 1)), media.full(b"mdhd", struct.pack(">IIII", 0, 0, 600, 0))
    moov = media.box(b"moov", media.box(b"mvex", trex), media.box(b"trak", tkhd, media.box(b"mdia", mdhd, media.box(b"minf", media.box(b"stbl", *tables)))))

    def moof(run, flags):
        size = len(media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1), flags=0x20000), media.full(b"trun", run(0), flags=flags))))
        return media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1), flags=0x20000), media.full(b"trun", run(size + 8), flags=flags)))

    one = moof(lambda at: struct.pack(">IiIIIII", 2, at, 0, 20, 2, 30, 4), 0x305)
    two = moof(lambda at: struct.pack(">Ii", 2, at), 0x001)
    file = moov + one + media.box(b"mdat", b"abcdef") + two + media.box(b"mdat", b"ghijkl")
    (track,) = media.probe(file)
    assert media.read_back(file, track) == b"abcdefghijkl" and track["duration"] == 70
    assert track["samples"][:, 1].tolist() == [2, 4, 3, 3] and track["keys"].tolist() == track["samples"][:1].tolist()


@given(st.binary(max_size=300), st.integers(0, 2**32), st.integers(0, 2**32))
@settings(max_examples=200, deadline=None)
def test_broken_files_are_read_as_far_as_they_go(raw, where, how_many):
    file = bytearray(media.mux(media.padded(raw)))
    at = where % len(file)
    file[at : at + 4] = struct.pack(">I", how_many % 2**32)
    for broken in (bytes(file), bytes(file[:at]), media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd"), media.box(b"stsz", bytes(6)), media.box(b"tkhd"), media.box(b"stz2", b"1234567"), media.box(b"stsc", raw)))), media.box(b"moof", media.box(b"traf", media.box(b"tfhd"), media.box(b"trun", raw)))):
        for track in media.probe(broken):
            media.read_back(broken, track)
            assert len(track["samples"]) <= len(broken)
