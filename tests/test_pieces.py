"""Pieces of byte tokens against Python's incremental decoder."""

import codecs
import random

from pagespring.operators.pieces import pieces


def test_pieces_match_an_incremental_decoder(spark):
    rng, rows, want = random.Random(6), [], {}
    for i in range(60):
        raw = "".join(rng.choice("aé漢😀 \n") for _ in range(rng.randint(1, 30))).encode()
        if i % 5 == 0:
            raw = raw[: rng.randint(1, len(raw))]  # may end inside a character
        decoder, at, pos = codecs.getincrementaldecoder("utf-8")(), 0, 0
        while at < len(raw):
            n = rng.randint(0, 5)
            token = raw[at : at + n]
            rows.append((i, pos, token if n or rng.random() < 0.5 else None))
            if token:
                want[i, pos] = (decoder.decode(token), decoder.getstate()[0])
            at, pos = at + n, pos + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, pos long, bytes binary")
    got = {(r["id"], r["pos"]): (r["piece"], bytes(r["left"])) for r in pieces(df).collect()}
    assert got == want


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, 0, b"a\xff"), (1, 1, b"b\xe6"), (1, 2, b"c"), (2, 0, b"\x80")], "id long, pos long, bytes binary")
    got = {(r["id"], r["pos"]): r["piece"] for r in pieces(df).collect()}
    assert got == {(1, 0): "a\ufffd", (1, 1): "b", (1, 2): "\ufffdc", (2, 0): "\ufffd"}
    assert pieces(df.limit(0)).count() == 0
