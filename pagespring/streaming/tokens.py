"""Token streams: what a decoder keeps of each page, as keyed state across micro-batches.

Of every page the state holds the tokens of its last ``window`` places, the place of the next
token, whether the stop suffix has been met, and the bytes of a character that has begun; so
it is bounded whatever the page's length.  A page that has stopped takes no further tokens,
or with ``again`` starts anew with a cleared state.

Defined results: tokens of one micro-batch count in the order of their ``pos``, those of later
ones after them; rows without a page or a token are left out; a token without bytes adds none;
bytes that are no UTF-8 become U+FFFD, as do those still pending when a page stops.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW = 64
STATE = "tail array<bigint>, place bigint, ended boolean, pending binary"
TOLD = "page_id bigint, place bigint, tail array<bigint>, ended boolean, text string"


def characters(pending: bytes, more: bytes, last: bool = False) -> tuple[str, bytes]:
    """The whole characters of pending and more bytes, and the bytes of one that has only begun."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    text = decoder.decode(pending + more, last)
    return text, decoder.getstate()[0]


def _order(pos):
    """A place to sort by; one of several fields comes as a dictionary."""
    return tuple(pos.values()) if isinstance(pos, dict) else pos


class Tail(StatefulProcessor):
    """Told once for each page of a micro-batch, and for each end with ``again``."""

    def __init__(self, stop: tuple[int, ...], window: int, again: bool) -> None:
        self.stop, self.window, self.again = list(stop), window, again

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("page", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tail, place, ended, pending, text = [], 0, False, b"", ""
        if self.state.exists():
            held = self.state.get()
            tail, place, ended, pending = list(held[0]), held[1], held[2], bytes(held[3])
        for r in sorted(rows, key=lambda r: _order(r["pos"])):
            if ended:
                if not self.again:
                    break
                yield self._told(key, place, tail, True, text)
                tail, place, ended, pending, text = [], 0, False, b"", ""
            tail, place = [*tail, r["token"]][-self.window :], place + 1
            ended = bool(self.stop) and tail[-len(self.stop) :] == self.stop
            new, pending = characters(pending, bytes(r["bytes"] or b""), ended)
            text += new
        self.state.update((tail, place, ended, pending))
        yield self._told(key, place, tail, ended, text)

    @staticmethod
    def _told(key, place, tail, ended, text) -> Row:
        return Row(page_id=key[0], place=place, tail=tail, ended=ended, text=text)

    def close(self) -> None:
        pass


def tails(tokens: DataFrame, stop: tuple[int, ...] = (), window: int = WINDOW, again: bool = False) -> DataFrame:
    """A stream (page_id, pos, token, bytes) to TOLD: how each page stands after a micro-batch, and
    the text that it adds.  Needs the RocksDB state store."""
    rows = tokens.where("page_id is not null and token is not null").select(
        F.col("page_id").cast("bigint"), "pos", F.col("token").cast("bigint").alias("token"), F.col("bytes").cast("binary").alias("bytes")
    )
    return rows.groupBy("page_id").transformWithState(Tail(stop, window, again), TOLD, "Update", "None")


def stateful(spark) -> None:
    """Sets the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
