"""Keyed state over a token stream against the batch queries, across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from pagespring import plans
from pagespring.plans import fixtures as fx
from pagespring.streaming import tokens as st


@pytest.fixture
def run(spark, tmp_path):
    """Streams frames through ``tails``, each as a file and a query of its own on one checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    st.stateful(spark)
    (tmp_path / "in").mkdir()

    def go(frames, **options):
        out = []
        for k, f in enumerate(frames):
            f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))

            def keep(df, _):
                out.extend((k, r) for r in df.collect())

            q = st.tails(stream, **options).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
            assert q.exception() is None
        return out

    yield go
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_events_as_a_stream_give_the_batch_query(spark, data, run):
    e = fx.table(spark, data, "events").selectExpr("user_id AS page_id", "struct(ts, event_id) AS pos", f"{fx.TOKEN} AS token", "CAST(event_type AS BINARY) AS bytes", "ntile(3) OVER (ORDER BY ts, event_id) AS part")
    told = run([e.where(F.col("part") == p).drop("part") for p in (1, 2, 3)])
    last = {r["page_id"]: r for _, r in sorted(told, key=lambda x: x[0])}
    want = {r["page_id"]: r for r in plans.QUERIES["token_tail_window"](spark, data).collect()}
    assert {p: r["tail"] for p, r in last.items()} == {p: r["tokens"] for p, r in want.items()}
    assert {p: r["tail"][-3:] == [11, 7, 5] for p, r in last.items()} == {p: r["ended"] for p, r in want.items()}
    counts = {r["page_id"]: r["n"] for r in e.groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    assert {p: r["place"] for p, r in last.items()} == counts


def plain(tokens, stop, window, again):
    """(tail, place, ended) after all tokens, and the texts of the pages' runs."""
    tail, place, ended, texts = [], 0, False, [b""]
    for token, data in tokens:
        if ended:
            if not again:
                break
            tail, place, ended = [], 0, False
            texts.append(b"")
        tail, place = (tail + [token])[-window:], place + 1
        texts[-1] += data or b""
        ended = tail[-len(stop) :] == list(stop)
    return tail, place, ended, texts


@pytest.mark.parametrize("again", [False, True])
def test_stops_clearing_and_pieces_of_characters(spark, run, again):
    rng = random.Random(again)
    texts = {p: ("aé漢😀 z" * 12).encode() for p in range(6)}
    rows, parts = [], []
    for p, raw in texts.items():
        at, pos = 0, 0
        while at < len(raw):
            n = rng.randint(0, 3)
            rows.append((p, pos, rng.choice([1, 2, 3]), bytes(raw[at : at + n]) if n else None))
            at, pos = at + n, pos + 1
    frame = "page_id long, pos long, token long, bytes binary"
    cut = [[r for r in rows if r[1] % 90 // 30 == k] for k in range(3)]
    for some in cut:
        some = some + [(None, 1, 1, b"x"), (1, 0, None, b"y")] if some is cut[0] else some
        rng.shuffle(some)
        parts.append(spark.createDataFrame(some, frame))
    told = run(parts, stop=(2, 3), window=4, again=again)
    ordered = {p: [(t, b) for _, _, t, b in sorted((r for some in cut for r in sorted(x for x in some if x[0] == p)), key=lambda r: (r[1] % 90 // 30, r[1]))] for p in texts}
    last = {}
    for _, r in told:
        last[r["page_id"]] = r
    for p, tokens in ordered.items():
        tail, place, ended, pieces = plain(tokens, (2, 3), 4, again)
        assert (last[p]["tail"], last[p]["place"], last[p]["ended"]) == (tail, place, ended)
        got = "".join(r["text"] for _, r in told if r["page_id"] == p)
        want = "".join(x.decode("utf-8", "replace") for x in pieces[:-1]) + (pieces[-1].decode("utf-8", "replace") if ended else st.characters(b"", pieces[-1])[0])
        assert got == want


def test_characters():
    raw = "aé漢😀".encode()
    for cut in range(len(raw) + 1):
        first, pending = st.characters(b"", raw[:cut])
        second, left = st.characters(pending, raw[cut:])
        assert first + second == "aé漢😀" and left == b""
    assert st.characters(b"\xe6", b"", last=True) == ("�", b"") and st.characters(b"", b"\xffa")[0] == "�a"
