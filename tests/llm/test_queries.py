"""The queries' own columns against plain versions, and against DuckDB where SQL can express them."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from driftgauge.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op3_jaccard", "op7_mixing"])
def test_against_duckdb(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = Q.queries()[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({Q.oracle_sql()[name]})").fetchall()
    rows = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x)
    assert rows(got.select(*sorted(got.columns)).collect()) == rows(want)


def test_tokens(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))
    rows = Q.op4_tokens(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts.items()}


def _crc(data):
    """CRC-16 of the format, bit by bit."""
    crc = 0xFFFF
    for byte in data:
        for i in range(7, -1, -1):
            top = (crc >> 15) ^ (byte >> i & 1)
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def _frames(media):
    """Offsets and payload of a stream of 48 kHz mono Layer III frames with checksums, behind an ID3v2 tag and before an ID3v1 tag; the first frame is the table."""
    assert media[:3] == b"ID3" and media[-128:-125] == b"TAG"
    at = 10 + sum(b << 7 * (3 - i) for i, b in enumerate(media[6:10]))
    rates = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    found, body = [], b""
    while at < len(media) - 128:
        assert media[at : at + 2] == b"\xff\xfa"
        size = 144_000 * rates[media[at + 2] >> 4] // 48_000 + (media[at + 2] >> 1 & 1)
        assert int.from_bytes(media[at + 4 : at + 6], "big") == _crc(media[at + 2 : at + 4] + media[at + 6 : at + 23])
        if b"Info" not in media[at : at + 64] and b"Xing" not in media[at : at + 64]:
            found.append(at)
            body += media[at + 23 : at + 23 + 576]
        at += size
    return found, body


def test_media(spark, texts):
    from driftgauge.llm import mpeg

    got = {r.doc_id: r for r in Q.op5_mpeg(spark, SF).collect()}
    media = {r.doc_id: bytes(r.media) for r in mpeg.store(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(got) == set(texts) == set(media)
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        offsets, body = _frames(media[i])
        r = got[i]
        assert body == payload and (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.frame_offsets_sha256) == (len(media[i]), sha(media[i]), sha(",".join(map(str, offsets))))
        assert f"frames={len(offsets)} samples={1152 * len(offsets)} rate=48000" in r.feature and r.feature.endswith(f"last={offsets[-1]}") and r.seconds == pytest.approx(0.024 * len(offsets))


def test_pieces(spark, texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from driftgauge.llm import pieces

    path = Q.tokenizer("piece_bpe_32k.model")
    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    for p, s in zip(m.pieces, pieces.load(path).scores, strict=True):
        p.score = float(s)
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    rows = {r.doc_id: r for r in Q.op6_pieces(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        r = rows[i]
        assert r.decoded_sha256 == sha(t.replace("\u2581", " ")) and r.round_trip == ("\u2581" not in t)
        if len(t) < 10_000:  # the library adds up longer paths in single precision
            ids = lib.encode(t)
            assert (r.n_pieces, r.ids_sha256, r.n_byte_pieces) == (len(ids), sha(" ".join(map(str, ids))), sum(lib.is_byte(x) for x in ids))


def test_urls_read_the_whole_table(spark):
    rows = {r.page_id: r for r in Q.op8_urls(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p.url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = max(((h + x, v) for h, x, v in Q.RULES if (host == h or host.endswith("." + h)) and path.startswith(x)), key=lambda f: (len(f[0]), f[0]), default=(None, None))
        assert (rows[p.page_id].host, rows[p.page_id].path, rows[p.page_id].rule) == (host, path, fit[0]) and rows[p.page_id].verdict in ([fit[1]] if fit[1] else ["allow", "block"])
