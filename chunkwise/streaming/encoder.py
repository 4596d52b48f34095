"""Streams: chunks of a stream of texts, encoded as they come, and an incremental coder whose state outlives a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cdf import cumulative
from ..functions.coder import Encoder
from ..operators import codec

STATE = "low long, high long, pending long, n_symbols long, tail array<int>"
SEGMENT = "key long, n_symbols long, closed boolean, bits binary, n_bits int"


def encode_stream(texts: DataFrame, keys: list[str], data: str, model: codec.Model, pin: int | None = None) -> DataFrame:
    """Encoded chunks of a stream of rows. No state: chunks are independent, so this is as good as a batch."""
    return codec.encode(codec.split(texts, keys, data, pin), model, keys)


def windowed_sizes(events: DataFrame, time: str, size: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, n, total) of tumbling windows; rows later than `late` are left out."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "n", "total")


def incremental(symbols: DataFrame, counts: list[int], timeout: str | None = None) -> DataFrame:
    """One bit stream for each key, over as many batches as it takes: (key, n_symbols, closed, bits, n_bits).

    symbols: key, position, symbol. Each batch gives the bits that are settled, whole bytes of them; the coder's state and the bits of an unfinished
    byte are kept. A negative symbol closes the stream: the coder is flushed and its state goes. With a timeout, so does a stream that falls silent.
    Of keys that never end only a few numbers are kept, however long they go on.
    """
    bounds = cumulative([counts])[0].tolist()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low, high, pending, n, tail = state.get if state.exists else (0, (1 << 32) - 1, 0, 0, [])
        coder, closed = Encoder(low, high, pending, list(tail)), state.hasTimedOut
        rows = [] if closed else [r for pdf in batches for r in zip(pdf["position"], pdf["symbol"])]
        for _, s in sorted(rows):
            if s < 0:
                closed = True
                break
            coder.put(bounds[s], bounds[s + 1])
            n += 1
        if closed:
            data, size = coder.finish(), len(coder.bits)
            state.remove()
        else:
            size = len(coder.bits) // 8 * 8
            data = bytes(int("".join(map(str, coder.bits[k : k + 8])), 2) for k in range(0, size, 8))
            state.update((coder.low, coder.high, coder.pending, n, coder.bits[size:]))
            if timeout:
                state.setTimeoutDuration(timeout)
        yield pd.DataFrame({"key": [key[0]], "n_symbols": [n], "closed": [closed], "bits": [data], "n_bits": [size]})

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return symbols.groupBy("key").applyInPandasWithState(step, SEGMENT, STATE, "append", kind)
